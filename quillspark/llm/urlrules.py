"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

Glob rules are packed into multiword Shift-And masks: a bit for each position of each pattern, 64 to a word.
All patterns of all rules run at once over every URL, and over a whole batch of URLs at once: for each
character the states move on by a shift, masked by that character's positions, and wildcard positions hold
their own. ``*`` stands for any characters but ``/``, ``**`` for any characters at all, ``?`` for one, of however many bytes in UTF-8.

Defined results: host and path are empty for a null url or one without ``://``; no rule then fits. Of the
rules that fit, the longest wins; of equally long ones, block before allow, then the first by code point. Where
none fits, the default verdict holds (allow). Repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common

# fixed values: the contract's rules
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
DEFAULT = "allow"
#: URLs that are matched together.
CHUNK = 4096
_END = 256


def globs_of(rule: str) -> list[str]:
    """A rule ``host/path`` fits its host and all subdomains, and paths that begin with its path."""
    host, slash, path = rule.partition("/")
    plain = "".join(f"\\{c}" if c in "*?\\" else c for c in host.lower() + slash + path)
    return [plain + "**", "*." + plain + "**"]


def canonical(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL."""
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return ("", "") if not m else (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2])


class Automaton:
    """Shift-And masks of several globs; bits of one pattern lie together, its first bit is the start state."""

    def __init__(self, globs: list[str]):
        starts, finals, bit = [], [], 0
        steps: list[tuple[int, object]] = []  # (bit, character it takes or None for any)
        loops: list[tuple[int, bool]] = []  # (bit, whether it also holds over /)
        tails: list[int] = []  # bits that hold over the further bytes of the character that they took
        for g in globs:
            starts.append(bit)
            i, data = 0, g.encode()
            while i < len(data):
                c = data[i : i + 1]
                if c == b"*":
                    wide = data[i : i + 2] == b"**"
                    loops.append((bit, wide))
                    i += 1 + wide
                    continue
                if c == b"\\":
                    i += 1
                    c = data[i : i + 1]
                bit += 1
                anything = c == b"?" and data[i - 1 : i] != b"\\"
                steps.append((bit, None if anything else c[0]))
                tails += [bit] * anything
                i += 1
            finals.append(bit)
            bit += 1
        self.words = -(-bit // 64) or 1
        self.finals = finals
        self.start = self._mask(starts)
        self.step = np.zeros((257, self.words), np.uint64)
        self.hold = np.zeros((257, self.words), np.uint64)
        for c in range(256):
            further = 0x80 <= c < 0xC0
            self.step[c] = self._mask([b for b, x in steps if x == c or x is None and not further])
            self.hold[c] = self._mask({*(b for b, wide in loops if wide or c != ord("/")), *(tails if further else [])})
        self.hold[_END] = ~np.uint64(0)  # after its end a URL keeps its states

    def _mask(self, bits) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return out

    def match(self, urls: list[bytes]) -> np.ndarray:
        """Booleans [URL, pattern]: whether the pattern takes the whole URL."""
        lengths = np.fromiter(map(len, urls), np.int64, len(urls))
        width = int(lengths.max(initial=0))
        flat = np.frombuffer(b"".join(urls), np.uint8)
        rows = np.full((len(urls), width), _END, np.uint16)
        rows[np.arange(width) < lengths[:, None]] = flat
        state = np.repeat(self.start[None, :], len(urls), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        for k in range(width):
            c = rows[:, k]
            moved = state << one
            moved[:, 1:] |= state[:, :-1] >> top
            state = (moved & self.step[c]) | (state & self.hold[c])
        return np.stack([(state[:, f // 64] >> np.uint64(f % 64)) & one for f in self.finals], axis=1).astype(bool) if self.finals else np.zeros((len(urls), 0), bool)

    def match_all(self, urls: list[bytes]) -> np.ndarray:
        """As match(); URLs of like length go together, so that one very long URL costs its own length alone."""
        order = sorted(range(len(urls)), key=lambda i: len(urls[i]))
        out = np.zeros((len(urls), len(self.finals)), bool)
        for k in range(0, len(order), CHUNK):
            part = order[k : k + CHUNK]
            cuts = [0, *(i for i in range(1, len(part)) if len(urls[part[i]]) > 1024 and len(urls[part[i]]) > 2 * len(urls[part[i - 1]])), len(part)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                out[part[a:b]] = self.match([urls[i] for i in part[a:b]])
        return out


def judge_urls(pages: DataFrame, rules=RULES, default: str = DEFAULT, keep: str = "page_id", url: str = "url") -> DataFrame:
    """(keep, host, path, rule, verdict, matched long): the verdict of the longest rule that fits each url."""
    best = sorted(set(rules), key=lambda r: (-len(r[0]), r[1] != "block", r[0]))

    def run(batches):
        globs = [globs_of(r) for r, _ in best]
        automaton = Automaton([g for gs in globs for g in gs])
        owner = np.repeat(np.arange(len(best)), [len(gs) for gs in globs])
        for batch in batches:
            parts = [canonical(u) for u in batch.column("url").to_pylist()]
            hits = automaton.match_all([(h + p).encode() for h, p in parts])
            fits = np.zeros((len(parts), len(best)), bool)
            for k, of in enumerate(owner):
                fits[:, of] |= hits[:, k]
            first = np.where(fits.any(axis=1), fits.argmax(axis=1), -1) if best else np.full(len(parts), -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array([best[i][0] if i >= 0 else None for i in first], pa.string()), pa.array([best[i][1] if i >= 0 else default for i in first], pa.string()), pa.array(fits.sum(axis=1), pa.int64())],
                ["key", "host", "path", "rule", "verdict", "matched"],
            )

    rows = pages.select(F.col(keep).alias("key"), F.col(url).alias("url"))
    out = common.map_batches(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, host string, path string, rule string, verdict string, matched long")
    return out.withColumnRenamed("key", keep)
