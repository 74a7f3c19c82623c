"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Candidate strings are long runs of key characters. A window slides over each; symbol counts
change by one in and one out, so the entropy of every window costs a constant. The threshold
depends on the character class of the window. Windows over it are merged to spans; windows over allow-listed
shapes and spans that a base pattern has found already are suppressed.

One pass over the texts in Arrow batches, no shuffle; memory is bounded by a batch.

Defined results: a null text is empty; an empty text has no spans; spans are in code points, end
exclusive; equal rows stay as many rows; a null id is passed through.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import pieces, runs

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "entropy")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Window of the entropy scan, in characters; shorter candidates are not judged.
WINDOW = 20


def expected_bits(symbols: int, n: int = WINDOW) -> float:
    """Mean entropy of ``n`` random characters of an alphabet of so many symbols."""
    return math.log2(n) - symbols / n * sum(math.comb(n, c) * (1 / symbols) ** c * (1 - 1 / symbols) ** (n - c) * c * math.log2(c) for c in range(1, n + 1))


#: So much below the mean, about 99 of 100 random keys of 32 characters have a window that reaches the threshold.
BELOW = 0.2
#: Least bits per character by class of the window's characters (20 distinct ones have 4.32): hex digits of one case, letters
#: of one case, letters of both, letters with separators (paths of words come near 3.9), digits and letters.
BITS = {"hex": expected_bits(16) - BELOW, "one_case": expected_bits(26) - BELOW, "two_cases": expected_bits(52) - BELOW, "letters": 4.2, "mixed": 3.6}
#: Shapes that are no secrets: UUIDs, documentation samples, runs of one symbol, the alphabet, and words (shorter than a window) with separators.
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
SAMPLE = re.compile(r"(?i)example|sample|placeholder|x{8,}|0123456789|abcdefghij")
PATH = re.compile(rf"[a-z]{{1,{WINDOW - 1}}}(?:[-_/][a-z]{{1,{WINDOW - 1}}})+", re.IGNORECASE)

_CANDIDATE = np.zeros(256, bool)
_CANDIDATE[[c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_=-"]] = True
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True


def _class(digits: int, letters: int, hexes: int, n: int, upper_hexes: int = 0, lowers: int = 0) -> str | None:
    """Class of a window from its counts of digits, letters, lower-case and upper-case hex digits and lower-case letters."""
    if digits == n or not letters:
        return None
    if hexes == n or upper_hexes == n:
        return "hex"
    if digits:
        return "mixed"
    if letters < n:
        return "letters"
    return "one_case" if lowers in (0, n) else "two_cases"


def entropy_spans(s: str, window: int = WINDOW, bits: dict | None = None) -> list[tuple[int, int]]:
    """Merged spans of the windows of ``s`` whose entropy reaches the threshold of their class."""
    bits = bits or BITS
    n = len(s)
    if n < window:
        return []
    weigh = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = digits = letters = hexes = upper_hexes = lowers = 0.0
    found: list[tuple[int, int]] = []
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        total += weigh[c + 1] - weigh[c]
        counts[ch] = c + 1
        digits += "0" <= ch <= "9"
        letters += ch.isalpha()
        hexes += ch in "0123456789abcdef"
        upper_hexes += ch in "0123456789ABCDEF"
        lowers += "a" <= ch <= "z"
        if i >= window:
            old = s[i - window]
            c = counts[old]
            total += weigh[c - 1] - weigh[c]
            counts[old] = c - 1
            digits -= "0" <= old <= "9"
            letters -= old.isalpha()
            hexes -= old in "0123456789abcdef"
            upper_hexes -= old in "0123456789ABCDEF"
            lowers -= "a" <= old <= "z"
        if i >= window - 1:
            kind = _class(digits, letters, hexes, window, upper_hexes, lowers)
            if kind and math.log2(window) - total / window >= bits[kind]:
                a, b = i - window + 1, i + 1
                if found and a <= found[-1][1]:
                    found[-1] = (found[-1][0], b)
                else:
                    found.append((a, b))
    return found


def judged_spans(s: str) -> list[tuple[int, int]]:
    """Entropy spans of a candidate, of the windows that overlap no sample; a UUID or a path of words is none."""
    if UUID.fullmatch(s):
        return []
    out, begin = [], 0
    for a, b in [*(m.span() for m in SAMPLE.finditer(s)), (len(s), len(s))]:
        out += [(begin + x, begin + y) for x, y in entropy_spans(s[begin:a])]
        begin = b
    return [(x, y) for x, y in out if not UUID.fullmatch(s[x:y]) and not PATH.fullmatch(s[x:y])]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans of assign and access, each kind leftmost and not overlapping."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return out


def _joined(spans) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))


def scan_piece(data: np.ndarray, starts: np.ndarray) -> dict[int, tuple[list, list]]:
    """Row in the piece -> (base spans, entropy spans), for rows that have any."""
    raw = data.tobytes()
    lowered = raw.lower()
    rows: set[int] = set()
    for needle, where in [(k, lowered) for k in KEYWORDS] + [(b"AKIA", raw)]:
        at = where.find(needle)
        while at >= 0:
            row = int(np.searchsorted(starts, at, side="right")) - 1
            rows.add(row)
            at = where.find(needle, max(int(starts[row + 1]) - len(needle) + 1, at + 1))
    texts = {r: raw[starts[r]:starts[r + 1]].decode("utf-8", "replace") for r in rows}
    out: dict[int, tuple[list, list]] = {r: (base_spans(t), []) for r, t in texts.items()}

    def point(row: int, at: int) -> int:
        part = data[starts[row]:at]
        return int(len(part) - np.count_nonzero((part & 0xC0) == 0x80))

    for a, b in zip(*runs(_HEX[data], starts, LEAST["hex"])):
        row = int(np.searchsorted(starts, a, side="right")) - 1
        p = point(row, a)
        out.setdefault(row, ([], []))[0].append(("hex", p, p + int(b - a)))
    for a, b in zip(*runs(_CANDIDATE[data], starts, WINDOW)):
        s = raw[a:b].decode("ascii")
        spans = judged_spans(s)
        if spans:
            row = int(np.searchsorted(starts, a, side="right")) - 1
            p, entry = point(row, a), out.setdefault(row, ([], []))
            base = entry[0]
            entry[1].extend(("entropy", p + x, p + y) for x, y in spans
                            if not any(u <= p + x and p + y <= v for _, u, v in base))
    return out


SCHEMA = "doc_id {id}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of each kind, ``base_sha256`` and all spans as ``kind:start:end``."""
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = SCHEMA.format(id=frame.schema["doc_id"].dataType.simpleString())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, starts in pieces(batch.column(1)):
                found = scan_piece(data, starts)
                cols: list[list] = [[], [], [], [], [], []]
                for r in range(last - first):
                    base, more = found.get(r, ((), ()))
                    for k, kind in enumerate(KINDS):
                        cols[k].append(sum(s[0] == kind for s in (*base, *more)))
                    cols[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    cols[5].append(_joined([*base, *more]))
                arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(c, pa.string()) for c in cols[4:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *arrays],
                                                 names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    return frame.mapInArrow(work, schema)
