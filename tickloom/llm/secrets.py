"""Secret scans: fixed patterns, and strings that a primed compressor finds novel."""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import bounded_batches, id_type

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
# runs of these classes are maximal, so asking for the least length at once drops the failing ones
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: What the novelty scan weighs: unbroken strings, of any length from LEAST on (under that many code points
#: no string of random signs stands out; the fixed patterns begin there too) ...
LEAST = 12
#: ... those shorter than MIXED only if their kind of sign changes at three places in ten or more, unlike a name's ...
MIXED = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST}}}")
#: ... with what dots join to them, as in signed tokens; a last part that is short and has no digit is prose ...
CHAIN = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.{1,2}[A-Za-z0-9+/_=-]+)*")
DOTTED = 16
#: ... after a word that makes its context sensitive.
SENSITIVE = re.compile(r"key|secret|token|passw|pwd|auth|credential|private|bearer|signature", re.IGNORECASE | re.ASCII)
#: Identifiers and phrases that prime the compressor: what stands in code without being secret.
IDENTIFIERS = (
    "import from return function class public private static void const final string integer boolean "
    "authorization authentication credential credentials certificate signature configuration environment "
    "access_token refresh_token client_secret client_id api_key private_key public_key secret_key password passwd "
    "username user_name session_id request response header content-type application/json http:// https:// localhost "
    "the and that with from this have which would there their what about will into more other could than first "
    "getUserName setPassword fromSession toString newInstance ClientFactory ServerManager RequestHandler "
    "ResponseBody ConfigService TokenProvider KeyStore CredentialId AccessKey SecretName "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)
#: Code points from the word to where the first string starts, at most.
REACH = 48
#: Code points that are weighed at once.
PIECE = 63


class Novelty:
    """Marginal compressed bytes of a string, given an identifier dictionary and the code around it."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 3):
        self.identifiers, self.level = identifiers.encode(), level

    def bits_per_char(self, before: str, candidate: str, after: str) -> float:
        """Of the most novel piece: from 64 bytes on, zstandard would pay for the alphabet and not for novelty."""
        around = (before + " " + after).encode("utf-8", "replace")
        primed = zstandard.ZstdCompressionDict(self.identifiers + b" " + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        press = zstandard.ZstdCompressor(level=self.level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
        own, none = candidate.encode(), len(press.compress(b""))
        k = -(-len(own) // PIECE)
        cuts = [len(own) * i // k for i in range(k + 1)]
        return max(8 * (len(press.compress(own[lo:hi])) - none) / (hi - lo) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True))


def alphabet_spread(s: str) -> int:
    """How many of lower case, upper case, digits and signs a string has."""
    return any(c.islower() for c in s) + any(c.isupper() for c in s) + any(c.isdigit() for c in s) + any(not c.isalnum() for c in s)


def kind_changes(s: str) -> int:
    """How often lower case, upper case and digits change in a string, but for words that begin with a capital."""
    kinds = "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "_" for c in s)
    return sum(pair in ("aA", "a0", "A0", "0a", "0A") for pair in map("".join, zip(kinds, kinds[1:], strict=False)))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points of what the three fixed patterns find."""
    low, out = text.lower(), []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def _free(lo: int, hi: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What of a span lies outside of ``taken``, disjoint spans in order."""
    i = max(0, bisect_right(taken, (lo, lo)) - 1)
    while lo < hi:
        while i < len(taken) and taken[i][1] <= lo:
            i += 1
        a, b = taken[i] if i < len(taken) else (hi, hi)
        if lo < min(a, hi):
            yield lo, min(a, hi)
        lo = max(lo, b)


def _disjoint(spans: Sequence[tuple[int, int, str]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi, _ in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _without_prose(text: str, lo: int, hi: int) -> int:
    """Where a chain from ``lo`` to ``hi`` ends without the prose that a dot joins to it."""
    while (dot := text.rfind(".", lo, hi)) >= 0 and hi - dot <= DOTTED and not any(c.isdigit() for c in text[dot:hi]):
        hi = dot if text[dot - 1] != "." else dot - 1
    return hi


def novel_spans(text: str, known: Sequence[tuple[int, int, str]], novelty: Novelty, least_bits: float = 6.5) -> list[tuple[int, int, str]]:
    """Strings after a sensitive word that stay long when compressed, apart from the known spans.

    A string is reported to its end, with the strings that dots join to it.
    """
    out: list[tuple[int, int, str]] = []
    taken = _disjoint(known)

    def is_novel(lo: int, hi: int) -> bool:
        own = text[lo:hi]
        if len(own) < LEAST or alphabet_spread(own) < 2 or not any(c.isdigit() for c in own):
            return False
        if len(own) < MIXED and 10 * kind_changes(own) < 3 * (len(own) - 1):
            return False
        return novelty.bits_per_char(text[max(0, lo - REACH) : lo], own, text[hi : hi + REACH]) >= least_bits

    begin = end = 0
    for word in SENSITIVE.finditer(text):
        at, stop = word.end(), min(len(text), word.end() + REACH + LEAST)
        while m := CANDIDATE.search(text, at, stop):
            lo = m.start()
            if begin <= lo < end:
                # a chain weighed before, from an earlier word: the rest counts by what follows this one
                runs = [RUN.match(text, lo, min(end, lo + PIECE))]
            else:
                begin, end = lo, CHAIN.match(text, lo).end()
                runs = RUN.finditer(text, lo, end)
            at = end
            first = next((a for run in runs for a, b in _free(*run.span(), taken) if is_novel(a, b)), None)
            if first is not None:
                for a, b in list(_free(first, _without_prose(text, first, end), taken)):
                    if text[a:b].strip("."):
                        out.append((a, b, "novel"))
                        insort(taken, (a, b))
    return out


def find_secrets(text: str, novelty: Novelty) -> list[tuple[int, int, str]]:
    """All spans of a text, by start and then kind in the order of KINDS."""
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, novelty), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str, spans: Sequence[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """The text with each maximal run of overlapping spans replaced by ``mark``."""
    out, end = [], 0
    for lo, hi, _ in sorted(spans):
        if lo >= end:
            out += [text[end:lo], mark]
        end = max(end, hi)
    return "".join([*out, text[end:]])


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the id column and ``found``, an array of (start, end, kind), code points.

    Kinds: assign, access and hex from fixed patterns; novel from compression.  Null and empty
    texts have no spans; texts and strings of any length are scanned whole.  Null ids are ids like
    others.  Repeated rows each have a row; an empty table gives an empty one.  Other columns,
    whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            rows = [[{"start": a, "end": b, "kind": k} for a, b, k in find_secrets(t.as_py() or "", novelty)] for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("sc_id"), pa.array(rows, kind)], ["sc_id", "found"])

    rows = bounded_batches(docs).select(F.col(id_col).alias("sc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"sc_id {id_type(docs, id_col).simpleString()}, found array<struct<start:long,end:long,kind:string>>").withColumnRenamed("sc_id", id_col)


def redact_secrets(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret span of its texts replaced by ``mark``, and the length column kept true.

    Rows and other columns stay, repeated rows too; an empty table gives an empty one.  A null text
    stays null, an empty one empty; texts of any length are redacted whole.  The length column is
    changed only where its text is, and left alone if it is null.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            texts = batch.column(names.index(text_col)).to_pylist()
            clean = [t if t is None else redact(t, find_secrets(t, novelty), mark) for t in texts]
            columns = list(batch.columns)
            columns[names.index(text_col)] = pa.array(clean, batch.schema.field(names.index(text_col)).type)
            if length_col in names:
                k = names.index(length_col)
                old = columns[k].to_pylist()
                columns[k] = pa.array([n if c is None or c == t else len(c) for n, c, t in zip(old, clean, texts, strict=True)], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return bounded_batches(docs).mapInArrow(run, docs.schema)
