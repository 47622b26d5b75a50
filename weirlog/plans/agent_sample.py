"""User agents and what each is, written out by hand: (text, browser, version, system, its version, device)."""

_MOZ, _WIN, _MAC, _KIT = "Mozilla/5.0", "(Windows NT 10.0; Win64; x64)", "(Macintosh; Intel Mac OS X 10_15_7)", "AppleWebKit/537.36 (KHTML, like Gecko)"
_PHONE, _PAD, _SAF = "(iPhone; CPU iPhone OS 17_1 like Mac OS X)", "(iPad; CPU OS 16_6 like Mac OS X)", "AppleWebKit/605.1.15 (KHTML, like Gecko)"
_DROID = "(Linux; Android 13; Pixel 7)"

AGENTS = [
    ("", "", "", "", "", ""),
    ("-", "", "", "", "", "Other"),
    (f"{_MOZ} {_WIN} {_KIT} Chrome/120.0.0.0 Safari/537.36", "Chrome", "120.0.0.0", "Windows", "10", "Desktop"),
    (f"{_MOZ} {_MAC} {_KIT} Chrome/119.0.0.0 Safari/537.36", "Chrome", "119.0.0.0", "macOS", "10.15.7", "Desktop"),
    (f"{_MOZ} (X11; Linux x86_64) {_KIT} Chrome/118.0.0.0 Safari/537.36", "Chrome", "118.0.0.0", "Linux", "", "Desktop"),
    (f"{_MOZ} (X11; CrOS x86_64 14541.0.0) {_KIT} Chrome/117.0.0.0 Safari/537.36", "Chrome", "117.0.0.0", "ChromeOS", "14541.0.0", "Desktop"),
    (f"{_MOZ} {_DROID} {_KIT} Chrome/116.0.0.0 Mobile Safari/537.36", "Chrome", "116.0.0.0", "Android", "13", "Mobile"),
    (f"{_MOZ} (Linux; Android 12; SM-X700) {_KIT} Chrome/115.0.0.0 Safari/537.36", "Chrome", "115.0.0.0", "Android", "12", "Tablet"),
    (f"{_MOZ} {_PHONE} {_SAF} CriOS/119.0.6045.109 Mobile/15E148 Safari/604.1", "Chrome", "119.0.6045.109", "iOS", "17.1", "Mobile"),
    (f"{_MOZ} {_PAD} {_SAF} CriOS/118.0.5993.92 Mobile/15E148 Safari/604.1", "Chrome", "118.0.5993.92", "iOS", "16.6", "Tablet"),
    (f"{_MOZ} {_WIN} {_KIT} HeadlessChrome/114.0.0.0 Safari/537.36", "Headless Chrome", "114.0.0.0", "Windows", "10", "Desktop"),
    (f"{_MOZ} (Windows NT 6.1; WOW64) {_KIT} Chrome/49.0.2623.112 Safari/537.36", "Chrome", "49.0.2623.112", "Windows", "7", "Desktop"),
    (f"{_MOZ} {_WIN} {_KIT} Chrome/120.0.0.0 Safari/537.36 Edg/120.0.2210.61", "Edge", "120.0.2210.61", "Windows", "10", "Desktop"),
    (f"{_MOZ} {_WIN} {_KIT} Chrome/64.0.3282.140 Safari/537.36 Edge/17.17134", "Edge", "17.17134", "Windows", "10", "Desktop"),
    (f"{_MOZ} {_DROID} {_KIT} Chrome/112.0.0.0 Mobile Safari/537.36 EdgA/112.0.1722.46", "Edge", "112.0.1722.46", "Android", "13", "Mobile"),
    (f"{_MOZ} {_PHONE} {_SAF} Version/17.0 EdgiOS/119.0.2151.65 Mobile/15E148 Safari/605.1.15", "Edge", "119.0.2151.65", "iOS", "17.1", "Mobile"),
    (f"{_MOZ} {_MAC} {_KIT} Chrome/118.0.0.0 Safari/537.36 OPR/104.0.0.0", "Opera", "104.0.0.0", "macOS", "10.15.7", "Desktop"),
    ("Opera/9.80 (Windows NT 6.0) Presto/2.12.388 Version/12.14", "Opera", "12.14", "Windows", "Vista", "Desktop"),
    ("Opera/9.80 (J2ME/MIDP; Opera Mini/9.80; U; en) Presto/2.5.25 Version/10.54", "Opera", "10.54", "", "", "Mobile"),
    (f"{_MOZ} (Linux; Android 11; SM-A525F) {_KIT} SamsungBrowser/23.0 Chrome/115.0.0.0 Mobile Safari/537.36", "Samsung Browser", "23.0", "Android", "11", "Mobile"),
    (f"{_MOZ} {_WIN} {_KIT} Chrome/116.0.0.0 YaBrowser/23.9.0 Safari/537.36", "Yandex", "23.9.0", "Windows", "10", "Desktop"),
    (f"{_MOZ} {_WIN} {_KIT} Chrome/118.0.0.0 Safari/537.36 Vivaldi/6.4.3160.41", "Vivaldi", "6.4.3160.41", "Windows", "10", "Desktop"),
    (f"{_MOZ} (Linux; U; Android 10; en-US; RMX1945) {_KIT} Version/4.0 Chrome/78.0.3904.108 UCBrowser/13.4.0.1306 Mobile Safari/537.36", "UC Browser", "13.4.0.1306", "Android", "10", "Mobile"),
    (f"{_MOZ} (Linux; U; Android 12; Redmi Note 9) {_KIT} Version/4.0 Chrome/100.0.4896.127 Mobile Safari/537.36 XiaoMi/MiuiBrowser/14.1.0", "MIUI Browser", "14.1.0", "Android", "12", "Mobile"),
    (f"{_MOZ} (Linux; Android 9; KFMAWI) {_KIT} Silk/108.4.6 like Chrome/108.0.5359.160 Safari/537.36", "Silk", "108.4.6", "Android", "9", "Tablet"),
    (f"{_MOZ} {_WIN} {_KIT} Chrome/111.0.0.0 Whale/3.20.182.12 Safari/537.36", "Whale", "3.20.182.12", "Windows", "10", "Desktop"),
    (f"{_MOZ} {_MAC} {_KIT} Chrome/114.0.5735.289 Electron/25.8.4 Safari/537.36", "Electron", "25.8.4", "macOS", "10.15.7", "Desktop"),
    (f"{_MOZ} (X11; Linux x86_64) {_KIT} Ubuntu Chromium/80.0.3987.87 Chrome/80.0.3987.87 Safari/537.36", "Chromium", "80.0.3987.87", "Linux", "", "Desktop"),
    (f"{_MOZ} (Windows NT 10.0; Win64; x64; rv:121.0) Gecko/20100101 Firefox/121.0", "Firefox", "121.0", "Windows", "10", "Desktop"),
    (f"{_MOZ} (Macintosh; Intel Mac OS X 10.15; rv:120.0) Gecko/20100101 Firefox/120.0", "Firefox", "120.0", "macOS", "10.15", "Desktop"),
    (f"{_MOZ} (X11; Ubuntu; Linux x86_64; rv:109.0) Gecko/20100101 Firefox/119.0", "Firefox", "119.0", "Linux", "", "Desktop"),
    (f"{_MOZ} (Android 13; Mobile; rv:120.0) Gecko/120.0 Firefox/120.0", "Firefox", "120.0", "Android", "13", "Mobile"),
    (f"{_MOZ} (Android 12; Tablet; rv:115.0) Gecko/115.0 Firefox/115.0", "Firefox", "115.0", "Android", "12", "Tablet"),
    (f"{_MOZ} {_PHONE} {_SAF} FxiOS/120.0 Mobile/15E148 Safari/605.1.15", "Firefox", "120.0", "iOS", "17.1", "Mobile"),
    (f"{_MOZ} (Windows NT 5.1; rv:52.0) Gecko/20100101 Firefox/52.0", "Firefox", "52.0", "Windows", "XP", "Desktop"),
    (f"{_MOZ} (X11; FreeBSD amd64; rv:102.0) Gecko/20100101 Firefox/102.0", "Firefox", "102.0", "FreeBSD", "", "Desktop"),
    (f"{_MOZ} (Windows NT 10.0; rv:60.0) Gecko/20100101 Firefox/60.0 SeaMonkey/2.53.14", "SeaMonkey", "2.53.14", "Windows", "10", "Desktop"),
    (f"{_MOZ} (Windows NT 10.0; rv:68.0) Gecko/20100101 Goanna/6.2 PaleMoon/32.2.0", "PaleMoon", "32.2.0", "Windows", "10", "Desktop"),
    (f"{_MOZ} {_MAC} {_SAF} Version/17.1 Safari/605.1.15", "Safari", "17.1", "macOS", "10.15.7", "Desktop"),
    (f"{_MOZ} {_PHONE} {_SAF} Version/17.1 Mobile/15E148 Safari/604.1", "Safari", "17.1", "iOS", "17.1", "Mobile"),
    (f"{_MOZ} {_PAD} {_SAF} Version/16.6 Mobile/15E148 Safari/604.1", "Safari", "16.6", "iOS", "16.6", "Tablet"),
    (f"{_MOZ} (iPod touch; CPU iPhone OS 12_5 like Mac OS X) {_SAF} Version/12.1.2 Mobile/15E148 Safari/604.1", "Safari", "12.1.2", "iOS", "12.5", "Mobile"),
    (f"{_MOZ} (Linux; U; Android 4.0.3; en-us) AppleWebKit/534.30 (KHTML, like Gecko) Version/4.0 Mobile Safari/534.30", "Android Browser", "4.0", "Android", "4.0.3", "Mobile"),
    ("Mozilla/4.0 (compatible; MSIE 8.0; Windows NT 6.1; Trident/4.0)", "Internet Explorer", "8.0", "Windows", "7", "Desktop"),
    (f"{_MOZ} (compatible; MSIE 10.0; Windows NT 6.2; Tablet PC 2.0; Trident/6.0)", "Internet Explorer", "10.0", "Windows", "8", "Desktop"),
    (f"{_MOZ} (Windows NT 6.3; WOW64; Trident/7.0; rv:11.0) like Gecko", "Internet Explorer", "11.0", "Windows", "8.1", "Desktop"),
    (f"{_MOZ} (compatible; Konqueror/4.5; FreeBSD) KHTML/4.5.4 (like Gecko)", "Konqueror", "4.5", "FreeBSD", "", "Desktop"),
    (f"{_MOZ} (Linux; Android 13; SM-S908B; wv) {_KIT} Version/4.0 Chrome/117.0.0.0 Mobile Safari/537.36 Instagram/301.0.0.0", "Instagram", "301.0.0.0", "Android", "13", "Mobile"),
    (f"{_MOZ} {_PHONE} {_SAF} Mobile/15E148 [FBAN/FBIOS;FBAV/438.0.0.33]", "Facebook", "438.0.0.33", "iOS", "17.1", "Mobile"),
    (f"{_MOZ} {_PHONE} {_SAF} Version/17.1 Mobile/15E148 DuckDuckGo/7 Safari/605.1.15", "DuckDuckGo", "7", "iOS", "17.1", "Mobile"),
    (f"{_MOZ} (compatible; Googlebot/2.1; +http://www.google.com/bot.html)", "Googlebot", "2.1", "", "", "Bot"),
    (f"{_MOZ} {_KIT[:-14]} like Gecko; compatible; bingbot/2.0; +http://www.bing.com/bingbot.htm) Chrome/103.0.5060.134 Safari/537.36", "bingbot", "2.0", "", "", "Bot"),
    (f"{_MOZ} (Linux; Android 6.0.1; Nexus 5X) {_KIT} Chrome/119.0.6045.123 Mobile Safari/537.36 (compatible; Googlebot/2.1)", "Googlebot", "2.1", "Android", "6.0.1", "Mobile"),
    (f"{_MOZ} (compatible; YandexBot/3.0; +http://yandex.com/bots)", "YandexBot", "3.0", "", "", "Bot"),
    (f"{_MOZ} (compatible; AhrefsBot/7.0; +http://ahrefs.com/robot/)", "AhrefsBot", "7.0", "", "", "Bot"),
    ("Sogou web spider/4.0", "", "", "", "", "Other"),
    ("curl/8.4.0", "curl", "8.4.0", "", "", "Other"),
    ("Wget/1.21.3 (linux-gnu)", "Wget", "1.21.3", "", "", "Other"),
    ("python-requests/2.31.0", "Python Requests", "2.31.0", "", "", "Other"),
    ("Python-urllib/3.11", "Python urllib", "3.11", "", "", "Other"),
    ("Go-http-client/2.0", "Go HTTP client", "2.0", "", "", "Other"),
    ("okhttp/4.12.0", "okhttp", "4.12.0", "", "", "Other"),
    ("Java/17.0.9", "Java", "17.0.9", "", "", "Other"),
    ("Apache-HttpClient/4.5.14 (Java/17.0.9)", "Apache HttpClient", "4.5.14", "", "", "Other"),
    ("axios/1.6.2", "Axios", "1.6.2", "", "", "Other"),
    ("PostmanRuntime/7.35.0", "Postman", "7.35.0", "", "", "Other"),
    ("Dalvik/2.1.0 (Linux; U; Android 11; SM-G973F)", "Dalvik", "2.1.0", "Android", "11", "Tablet"),
    (f"{_MOZ} (Windows Phone 10.0; Android 6.0.1; Microsoft; Lumia 950) {_KIT} Chrome/52.0.2743.116 Mobile Safari/537.36 Edge/15.15254", "Edge", "15.15254", "Windows Phone", "10.0", "Mobile"),
    (f"{_MOZ} (compatible; MSIE 10.0; Windows Phone 8.0; Trident/6.0; IEMobile/10.0; NOKIA)", "Internet Explorer", "10.0", "Windows Phone", "8.0", "Mobile"),
    (f"{_MOZ} (SMART-TV; Linux; Tizen 6.0) {_KIT} SamsungBrowser/4.0 Chrome/76.0.3809.146 Safari/537.36", "Samsung Browser", "4.0", "Tizen", "6.0", "TV"),
    (f"{_MOZ} (Mobile; rv:84.0) Gecko/84.0 Firefox/84.0 KAIOS/3.0", "Firefox", "84.0", "KaiOS", "", "Mobile"),
    ("Lynx/2.8.9rel.1 libwww-FM/2.14", "Lynx", "2.8.9rel.1", "", "", "Other"),
]
