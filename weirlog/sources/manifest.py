"""What a store consists of at a moment: numbered documents, of which the last one counts.

Tables are written under names of their own first and counted in by the next document, which is created only if nobody else has created
it. So readers see a write as a whole or not at all, a write that dies leaves nothing but files that no document names, and
of two writers one has to look again at what the other has done.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from weirlog.sources.files import Files


class Manifest:
    def __init__(self, files: Files, root: str):
        self.files, self.folder = files, f"{root}/manifests"

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(self.folder) if n[:-5].isdigit() and n.endswith(".json"))

    def read(self, number: int) -> dict:
        return json.loads(self.files.read(f"{self.folder}/{number:012}.json"))

    def latest(self) -> tuple[int, dict] | None:
        found = self.numbers()
        return (found[-1], self.read(found[-1])) if found else None

    def begin(self, content: dict) -> bool:
        return self.files.create(f"{self.folder}/{0:012}.json", json.dumps(content))

    def change(self, make: Callable[[dict], dict | None]) -> dict | None:
        """Makes the next document of the last one, again if another writer was faster; None, and nothing, where make() returns None."""
        while True:
            number, content = self.latest()
            content = make(content)
            if content is None or self.files.create(f"{self.folder}/{number + 1:012}.json", json.dumps(content)):
                return content

    def trim(self, keep: int) -> list[dict]:
        """Removes all documents but the last ones, and returns these."""
        *old, = self.numbers()
        for n in old[:-keep]:
            self.files.remove(f"{self.folder}/{n:012}.json")
        return [self.read(n) for n in old[-keep:]]
