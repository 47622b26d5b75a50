"""Names and patterns that labels depend on, and readers for a user's own lists."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

# User agents of crawlers, matched anywhere in the lower-cased user agent.
CRAWLERS = """
Chef Client
Abonti
SISTRIX
DotBot
Speedy Spider
Sosospider
BPImageWalker
DoCoMo
GSLFbot
YodaoBot
AddThis
Purebot
CCBot
findlinks
ichiro
Linguee Bot
Gigabot
BacklinkCrawler
distilator
Aboundex
UnwindFetchor
SBIder
TestNutch
DomainCrawler
NextGenSearchBot
SEOENGWorldBot
Cityreview
PagePeeker
JS-Kit
ScreenerBot
ShowyouBot
SolomonoBot
Domnutch
MaxPoint
NCBot
TosCrawler
Updownerbot
OpenWebSpider
WordPress
PEAR
ZumBot
YisouSpider
W3C
vcheck
PercolateCrawler
NING
gvfs
CatchBot
Combine
A6-Indexer
Altresium
Comodo
crawler4j
Cricket
EC2LinkFinder
envolk
GeoHasher
HTMLParser
MLBot
Jaxified
LinkWalker
nutch
PostRank
keybase-proofs
CommonCrawler
X-CAD-SE
Safeassign
Nmap
sqlmap
Jorgee
PxBroker
Seekport
adscanner
AfD-Verbotsverfahren_JETZT!
DuckDuckGo-favicons-Bot
bingbot
PetalBot
Discordbot
ZoominfoBot
Googlebot
AhrefsBot
SemrushBot
Adsbot
BLEXBot
NetcraftSurveyAgent
Netcraft Web Server Survey
masscan
MJ12bot
Pandalytics
YandexBot
Nimbostratus-Bot
SeznamBot
AppleBot
""".strip().splitlines()
MORE_BOTS = """
Googlebot
bingbot
AdsBot-Google
APIs-Google
Mediapartners-Google
Storebot-Google
Google-InspectionTool
Google-Extended
GoogleOther
AhrefsBot
SemrushBot
MJ12bot
Baiduspider
YandexBot
YandexImages
DuckDuckBot
facebookexternalhit
meta-externalagent
meta-externalfetcher
Twitterbot
LinkedInBot
Applebot
Pinterest
SkypeUriPreview
TelegramBot
Discordbot
Slackbot
WhatsApp
PetalBot
Bytespider
DataForSeoBot
SeznamBot
Qwantify
archive.org_bot
ia_archiver
CCBot
ClaudeBot
anthropic-ai
GPTBot
ChatGPT-User
OAI-SearchBot
PerplexityBot
cohere-ai
Amazonbot
YouBot
Diffbot
ImagesiftBot
Timpibot
Omgilibot
Bytedance
headless
python-requests
curl/
wget/
Go-http-client
okhttp
axios
node-fetch
libwww-perl
Java/
Scrapy
Apache-HttpClient
Jakarta Commons-HttpClient
masscan
nmap
zgrab
Nuclei
SecurityScanner
""".strip().splitlines()
BOT_TOKENS = """
bot
crawl
spider
slurp
check_http
monitoring
pingdom
uptime
""".strip().splitlines()

# File name extensions of static content.
STATIC_EXTENSIONS = """
js
mjs
css
map
scss
less
jpg
jpeg
png
gif
webp
avif
svg
ico
cur
bmp
tiff
woff
woff2
ttf
otf
eot
mp4
webm
mov
ogv
m4v
mp3
wav
m4a
ogg
flac
aac
opus
pdf
webmanifest
appcache
txt
""".strip().splitlines()

# reason=substring of the lower-cased URI, in order; "re:" marks a regular expression on the URI as it is.
ATTACKS = r"""
wordpress=wp-login.php
wordpress=wp-admin/
wordpress=wp-content/
wordpress=wp-includes/
wordpress=xmlrpc.php
wordpress=wp-config
wordpress=wlwmanifest.xml
env-file=/.env
git-dir=/.git/
aws-creds=/.aws/
ssh-dir=/.ssh/
docker-cfg=/.docker/
config-file=/config.json
config-file=/config.php
config-file=/config.yml
config-file=/settings.php
phpmyadmin=/phpmyadmin
phpmyadmin=/pma/
phpmyadmin=/myadmin
phpmyadmin=/dbadmin
adminer=/adminer
adminer=adminer.php
cpanel=/cpanel
plesk=/plesk
server-info=server-status
server-info=server-info
server-info=/info.php
server-info=/phpinfo
actuator=/actuator/env
actuator=/actuator/heapdump
actuator=/actuator/mappings
webshell=/shell.php
webshell=/c99.php
webshell=/r57.php
webshell=/alfa.php
webshell=/cmd.php
webshell=/wso.php
webshell=/up.php
router=/boaform
router=/hnap1
router=/setup.cgi
router=/GponForm
router=/goform/
router=/admin/formLogin
exchange=/owa/
exchange=/ecp/
exchange=/autodiscover
exchange=/ews/exchange.asmx
cloud-metadata=/latest/meta-data
cloud-metadata=/metadata/identity
cloud-metadata=/computeMetadata/
backup=/backup.zip
backup=/backup.sql
backup=/backup.tar
backup=/dump.sql
backup=/database.sql
backup=/db.sql
solr=/solr/
jenkins=/jenkins/
joomla=/administrator/index.php
drupal=/user/register
magento=/downloader
re:env-file-any=/\.env($|\.|/)
re:dotfile=/\.[a-z_]+/config
re:traversal=(\.\.|%2e%2e)(/|\\\\|%2f|%5c)
probe=/robots.txt.bak
probe=/.htaccess
probe=/.htpasswd
probe=/wordpress/
probe=/old/
probe=/test/
probe=/bak/
""".strip().splitlines()
SCRIPT_EXTENSION = ("script-extension", r"(?i)\.(php|phtml|php5|php7|asp|aspx|jsp|cgi)(\?|/|$)")

# Probes of the probe-only rule and their tags, static URIs that browsers fetch on their own.
PROBES = [
    ("/.well-known/traffic-advice", "bot"), ("/ip", "malicious"), ("/cdn-cgi/trace", "malicious"), ("/.vscode/sftp.json", "malicious"), ("/sftp-config.json", "malicious"),
    ("/sitemap.xml", "bot"), ("/vendor/phpunit/phpunit/phpunit.xsd", "malicious"), ("/my-account/", "malicious"), ("/", "bot"),
]
IGNORED_STATIC = ["/favicon.ico", "/img/favicon.ico", "/img/slack-card.png", "/robots.txt"]


@dataclass(frozen=True)
class AttackRules:
    """Substrings come before regular expressions, each in the order of the list."""

    substrings: tuple[tuple[str, str], ...]
    regexes: tuple[tuple[str, str], ...]


def split_reason(pattern: str) -> tuple[str, str]:
    """A reason before '=' has at most 39 characters; without one the pattern itself is the reason."""
    at = pattern.find("=")
    if 0 < at < 40:
        return pattern[:at].strip(), pattern[at + 1 :].strip()
    return pattern.lstrip("/")[:40], pattern


def attack_rules(lines: list[str] | None = None, extra: list[str] = (), script_extension: bool | None = None) -> AttackRules:
    """Rules of a list (the built-in one by default) and of extra patterns; the script extension rule comes with the former."""
    parts: tuple[list, list] = ([], [])
    for line in [*(ATTACKS if lines is None else lines), *extra]:
        line = line.strip()
        if line and not line.startswith("#"):
            regex = line.startswith("re:")
            reason, pattern = split_reason(line[3:].strip() if regex else line)
            parts[regex].append((reason, pattern if regex else pattern.lower()))
    if script_extension or (script_extension is None and lines is None):
        parts[1].append(SCRIPT_EXTENSION)
    return AttackRules(*map(tuple, parts))


def bot_patterns(lines: list[str] | None = None, extra: list[str] = ()) -> list[str]:
    """Distinct lower-cased patterns, of a list or the built-in ones, and extra ones."""
    found = [*(CRAWLERS + MORE_BOTS if lines is None else lines), *extra]
    return list(dict.fromkeys(p.strip().lower() for p in found if p.strip() and not p.startswith("#")))


def crawlers_of(text: str) -> list[str]:
    """Names of type Crawlers in a list of names and types between tabs."""
    rows = [[f for f in line.split("\t") if f] for line in text.splitlines() if line and not line.startswith("#")]
    return [" ".join(r[:-1]) for r in rows if len(r) > 1 and r[-1].strip().lower() == "crawlers"]


def pattern_file(path: str) -> list[str]:
    return [x.strip() for x in Path(path).read_text(encoding="utf-8").splitlines() if x.strip() and not x.startswith("#")]


def probe_file(path: str) -> list[tuple[str, str]]:
    """A JSON list of {uri, tag}; a missing file raises FileNotFoundError, anything unfit ValueError."""
    import json

    found = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(found, list) or not found:
        raise ValueError("a probe list needs at least one entry")
    out = []
    for x in found:
        if not isinstance(x, dict) or not x.get("uri"):
            raise ValueError("a probe needs a uri")
        if x.get("tag") not in ("bot", "malicious"):
            raise ValueError(f"unknown tag {x.get('tag')!r}")
        out.append((x["uri"], x["tag"]))
    return out
