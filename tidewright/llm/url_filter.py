"""Allow and block lists for URLs as a trie over reversed host labels and path segments.

``Trie`` is built once from the rules and travels with the task (a broadcast
of the rules' size, which is checked).  A walk goes down the host labels from
the top-level domain; at every host node that carries path rules it goes down
the path segments.  The deepest host, and there the longest path, wins: an
allow entry below a block entry is an exception to it, and the other way round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import arrow_map

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: What holds for a URL that no rule fits.
DEFAULT = "allow"
#: Rules beyond this do not travel with every task.
MOST_RULES = 2_000_000

_UPPER = {k: k + 32 for k in range(65, 91)}


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null and without ``://``."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    host = rest[: end if slash < 0 else slash]
    return host.translate(_UPPER), "" if slash < 0 else rest[slash:end]


def segments(path: str) -> list[str]:
    """The path cut behind every slash: '/en/a' is '/', 'en/', 'a'."""
    pieces = path.split("/")
    return [p + "/" for p in pieces[:-1]] + ([pieces[-1]] if pieces[-1] else [])


class Paths:
    """A path trie's node: the next segments, and the rules that end here, by the start of a segment that they still ask for."""

    __slots__ = ("ends", "following")

    def __init__(self):
        self.following: dict[str, Paths] = {}
        self.ends: dict[str, tuple[str, str]] = {}


class Host:
    """A host trie's node: the labels below it, and the path rules of the host itself."""

    __slots__ = ("below", "paths")

    def __init__(self):
        self.below: dict[str, Host] = {}
        self.paths: Paths | None = None


class Trie:
    """Longest-match lookup; a rule is (verdict, host, path) with the path as a prefix.  Of rules with one host and path the last one holds."""

    def __init__(self, rules=RULES, default: str = DEFAULT):
        if len(rules) > MOST_RULES:
            raise ValueError(f"{len(rules)} rules; join them by host instead of broadcasting more than {MOST_RULES}")
        self.default = default
        self.root = Host()
        for verdict, host, path in rules:
            place = self.root
            for label in reversed(host.translate(_UPPER).split(".")) if host else ():
                place = place.below.setdefault(label, Host())
            place.paths = node = place.paths or Paths()
            cuts = segments(path)
            whole = cuts if path.endswith("/") or not path else cuts[:-1]
            for piece in whole:
                node = node.following.setdefault(piece, Paths())
            # a last piece without a slash is a prefix of a segment
            node.ends["" if whole == cuts else cuts[-1]] = (verdict, f"{host}{path}")

    def match(self, host: str, path: str) -> tuple[str | None, str]:
        """(rule, verdict) of the longest fitting rule, or (None, default)."""
        place = self.root
        deep = [place.paths] if place.paths else []
        for label in reversed(host.split(".")) if host else ():
            place = place.below.get(label)
            if place is None:
                break
            if place.paths:
                deep.append(place.paths)
        cuts = segments(path) if deep else []
        for node in reversed(deep):
            best, done = None, 0
            while node is not None:
                rest = cuts[done] if done < len(cuts) else ""
                fits = [(len(k), v) for k, v in node.ends.items() if rest.startswith(k)]
                best = max(fits, default=(0, best))[1]
                node = node.following.get(rest) if rest else None
                done += 1
            if best:
                return best[1], best[0]
        return None, self.default


def judge_urls(df: DataFrame, url: str = "url", key: str = "page_id", rules=RULES, default: str = DEFAULT) -> DataFrame:
    """(key, host, path, rule, verdict), one row for each row of df, null and odd URLs included.

    Rows are judged where they are read; repeated keys stay repeated.  rule is
    null where none fits, and then the verdict is the default.
    """
    broadcast = df.sparkSession.sparkContext.broadcast(Trie(rules, default))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = broadcast.value
        for batch in batches:
            seen = [parts(u) for u in batch.column(1).to_pylist()]
            found = [trie.match(*p) for p in seen]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.string()) for c in ([p[0] for p in seen], [p[1] for p in seen], [f[0] for f in found], [f[1] for f in found]))],
                names=[key, "host", "path", "rule", "verdict"],
            )

    kind = df.schema[key].dataType.simpleString()
    return arrow_map(df.select(df[key], df[url]), over, f"`{key}` {kind}, host string, path string, rule string, verdict string")
