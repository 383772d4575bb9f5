"""Stand-ins for services that sources read: they count what is asked of them, in files, as tasks run in other processes."""

import json
import os
import tempfile

LOG = os.environ.get("QUERN_FEEDS_LOG", os.path.join(tempfile.gettempdir(), f"quern-feeds-{os.getuid()}"))


def told(what: str) -> None:
    with open(LOG, "a") as f:
        f.write(what + "\n")


def asked() -> list[str]:
    return open(LOG).read().split("\n")[:-1] if os.path.exists(LOG) else []


def forget() -> None:
    open(LOG, "w").close()


class Wiki:
    """23 pages in a chain of spaces; page k changed at minute k, second 30."""

    PAGES = [{"id": k, "title": f"T{k}", "html": f"<p>page {k}</p>", "author": "A", "when": f"2024-01-01T00:{k:02d}:30Z", "version": k + 1, "parent": None if k < 2 else str(k // 2)} for k in range(23)]

    def search(self, space, since, start, limit):
        found = [p for p in self.PAGES if since is None or p["when"][:16].replace("T", " ") >= since]
        told(f"search {since} {start}")
        return found[start : start + limit]

    def one(self, key):
        told(f"one {key}")
        return next((p for p in self.PAGES if str(p["id"]) == key), None)


class Chat:
    """Messages of a file that grows, two at a time."""

    def __init__(self, path: str):
        self.path = path

    def _all(self, channel):
        return sorted((m for m in map(json.loads, open(self.path)) if m["channel"] == channel), key=lambda m: float(m["ts"]))

    def latest(self, channel):
        found = self._all(channel)
        return found[-1]["ts"] if found else None

    def history(self, channel, after, upto, cursor):
        told(f"history {channel} {cursor}")
        found = [m for m in self._all(channel) if float(after) <= float(m["ts"]) <= float(upto)]
        at = int(cursor or 0)
        return found[at : at + 2], str(at + 2) if at + 2 < len(found) else None


wiki = Wiki()
chat = Chat(LOG + "-chat")
