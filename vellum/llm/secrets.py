"""Secret scans: fixed patterns, and zstandard novelty in a sensitive context."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import map_rows, map_whole, quoted, text_of, with_columns

# The base patterns, and the order of kinds at one start.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")
# Words that make a place sensitive.
SENSITIVE = ("password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "access_key", "private_key", "client_key", "credential", "authorization", "bearer", "signature", "session")
SENSITIVE_AT = re.compile("(?i:" + "|".join(SENSITIVE) + ")", re.ASCII)
LEAST = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: What stands together without a space, quote or bracket; a password with signs in it is measured as one string.
RUN = re.compile(r"[A-Za-z0-9!#$%&*+./:=?@\\^_|~-]+")
SIGNS = re.compile(r"[!#$%&*^~|\\]")
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Parts of a date or of a numbered name, which don't make a string a secret: years, numbers of two digits, a day with an hour.
NUMBERED = re.compile(r"(?:19|20)\d\d|\d{1,2}(?:[Tt]\d{1,2})?")
PARTS = re.compile(r"[-_/=+]+")
# Identifiers and code that secrets are set against.
IDENTIFIERS = "abstract address application argument array assert async attribute authorization await bearer begin boolean bucket buffer build bytes cache callback catch certificate channel char class client cluster code collection column commit component config configuration connection console const constructor container content context controller cookie count counter create credential current cursor data database date debug default define delete description destination dictionary directory document domain double element else email encoding endpoint entity enum environment error event example except exception execute export extends extension factory false field file filename filter final finally float folder format function generate group handler hash header height helper host https identifier image implements import index information init input insert instance integer interface internal invalid iterator json kernel label lambda language length level library limit line link list listener load local location logger login long manager mapping master match maximum memory message method minimum model module name namespace network node null number object offset online operation option order output package page parameter parent parse partition pass path pattern payload permission pipeline plugin pointer policy position prefix previous primary private process production profile project property protocol provider proxy public query queue random range read record reference region register registry release remote remove render replace repository request required reset resource response result return role route rule runtime sample scheduler schema scope script search section security select sequence server service session setting signature size socket source stack start state static status storage stream string struct submit suffix summary super switch system table target task template test text thread throw timeout timestamp title token total trace transaction transform true type undefined unique update upload user username utility valid value variable vector version view void warning webhook width window workflow wrapper write"
CODE = " = os.environ.get(\" = getenv(' if __name__ == \"__main__\": import json public static final String const require(' export default function() { return } \"Authorization\": \"Bearer \" https://www.example.com/api/v1/ 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ aaaaaaaa 00000000 -------- ======== xxxxxxxx ________ your_api_key_here changeme placeholder example_password "
# Parts of words of prose, so that long words beside a sensitive one compress.
WORD_PARTS = " ation ition ement ments ness able ible ance ence ology graphy ically ously ively fulness isation ionalization ality ivity ability under over inter trans super counter micro multi auto self anti pre pro con com dis mis non sub thing thought light standing character other people heit keit igkeit lichkeit schaft schaften ungen lichen isch ische voll ver ent zer auf aus ein zusammen arbeit anwalt kanzlei rechts verantwort geschwindig begrenz welt anschau wissen entwick verwalt gesell mensch zeit ements ellement ivement ativement ique isme iste eur euse teur aires able ité dévelop constitu adminis natio ción ciones miento mente idad idades ador encia ancia ismo respons caracter cional desarrollo "
#: Put before what is measured. It stands in the dictionary, so the frame is always a compressed one and its cost drops out.
FRAME = "return result; private static final configuration connection application environment "
REACH = 48
MIN_BITS = 4.0
#: Strings of letters only, which may be words, are measured from this length on and against this figure.
LETTERS_FROM = 24
LETTERS_MIN_BITS = 5.0
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def primed_dictionary() -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict((CODE + IDENTIFIERS + " " + IDENTIFIERS.upper() + WORD_PARTS + FRAME).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Novelty:
    """Marginal compressed bits of a string against the words around it and the dictionary."""

    def __init__(self) -> None:
        self.packer = zstandard.ZstdCompressor(level=19, dict_data=primed_dictionary(), write_content_size=False, write_checksum=False, write_dict_id=False)

    def bits_per_char(self, before: str, candidate: str, after: str) -> float:
        """The lowest of the figures for the string as it is, in lower case, and as the words of a name in code."""
        around = (FRAME + before + after).encode()
        alone = len(self.packer.compress(around))
        low = candidate.lower()
        forms = {candidate, low, CAMEL.sub(" ", candidate).replace("_", " ").lower()}
        more = min(len(self.packer.compress(around + value.encode())) for value in forms)
        return 8 * (more - alone) / max(1, len(candidate))


def is_sensitive(text: str) -> bool:
    low = text.lower()
    return any(word in low for word in SENSITIVE)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind by the fixed patterns; a span of ``assign`` is its whole match."""
    out = []
    if is_sensitive(text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def with_signs(run: str) -> bool:
    """Whether a run is measured whole: signs inside it, both cases and digits, and no address."""
    if len(run) < LEAST or "://" in run or not SIGNS.search(run) or ADDRESS.fullmatch(run):
        return False
    return any(map(str.isupper, run)) and any(map(str.islower, run)) and any(map(str.isdigit, run))


def candidates(text: str, reach: int) -> Iterator[tuple[int, int]]:
    """Strings of at least 12 characters that start at most ``reach`` characters behind a sensitive word.

    A run without a space, quote or bracket is one string if ``with_signs`` says
    so; otherwise the pieces of it between signs are. No string is cut by a
    sensitive word inside it, and none is looked at twice: what one word doesn't
    reach is left for the next, so every character is read a bounded number of times.
    """
    at = run_end = 0
    for m in SENSITIVE_AT.finditer(text):
        at, last = max(at, m.end()), m.end() + reach
        while at <= last and (found := RUN.search(text, at, min(len(text), last + 1))):
            start = found.start()
            if start >= run_end:
                run_end = RUN.match(text, start).end()
                run = text[start:run_end]
                whole = run.strip(":=.?!/-")
                if with_signs(whole):
                    left = start + len(run) - len(run.lstrip(":=.?!/-"))
                    yield left, left + len(whole)
                    at = run_end
                    continue
            at = run_end
            for piece in CANDIDATE.finditer(text, start, run_end):
                if piece.start() > last:
                    at = piece.start()
                    break
                yield piece.span()


def counted(value: str) -> tuple[int, bool]:
    """Letters of a string, and whether it has digits that count: not those of dates and numbered names, nor the number behind a long name."""
    parts = [p for p in PARTS.split(value) if p and not NUMBERED.fullmatch(p)]
    letters = sum(map(str.isalpha, "".join(parts)))
    if letters >= LETTERS_FROM:
        parts = [p.rstrip("0123456789") if len(p) - len(p.rstrip("0123456789")) <= 4 else p for p in parts]
    return letters, any(map(str.isdigit, "".join(parts)))


def novel_spans(text: str, taken: list[tuple[int, int, str]], novelty: Novelty, *, reach: int = REACH, min_bits: float = MIN_BITS, letters_min_bits: float = LETTERS_MIN_BITS) -> list[tuple[int, int, str]]:
    """Strings that do not compress, shortly after a sensitive word.

    Measured is every candidate that does not lie wholly inside a base span and
    has letters and digits both, or at least ``LETTERS_FROM`` letters: shorter
    ones can't be told from words of prose. Digits of dates, of numbers of two
    digits between dashes, and of up to four behind a long name don't count.
    """
    if not is_sensitive(text):
        return []
    out, starts, furthest = [], [s[0] for s in taken], list(accumulate((s[1] for s in taken), max))
    for start, end in candidates(text, reach):
        before = bisect_right(starts, start)
        if before and furthest[before - 1] >= end:
            continue
        value = text[start:end]
        letters, digits = counted(value)
        if not letters or not (digits or letters >= LETTERS_FROM):
            continue
        if novelty.bits_per_char(text[max(0, start - reach) : start], value, text[end : end + reach]) >= (min_bits if digits else letters_min_bits):
            out.append((start, end, "novel"))
    return out


def scanner(reach: int = REACH, min_bits: float = MIN_BITS):
    novelty = Novelty()

    def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        base = base_spans(text)
        return base, novel_spans(text, base, novelty, reach=reach, min_bits=min_bits)

    return scan


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, min_bits: float = MIN_BITS) -> DataFrame:
    """Secrets of every document, as counts, a digest of the base spans, and all spans.

    Spans are ``kind:start:end`` in code points, end exclusive. Null text is
    empty and has none. Overlapping spans of different kinds all stay; a novel
    span never lies wholly inside a base one. Only strings that pass the gates
    of ``novel_spans`` are measured; a name in code of ``LETTERS_FROM`` letters
    or more that is unlike any known one counts as a secret.
    """

    def start():
        scan = scanner(reach, min_bits)

        def one(doc_id: int | None, text: str) -> Iterator[tuple]:
            base, novel = scan(text)
            count = [sum(s[2] == kind for s in base) for kind in KINDS[:3]]
            yield doc_id, *count, hashlib.sha256(written(base).encode()).hexdigest(), written(base + novel), len(novel)

        return one

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint"
    return map_rows(docs, [F.col(quoted(id_col)).cast("bigint"), text_of(quoted(text_col))], schema, start)


def masked(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    """The text with each run of overlapping spans replaced by ``mask``."""
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = None, mask: str = "[secret]", reach: int = REACH, min_bits: float = MIN_BITS) -> DataFrame:
    """The same rows and columns with every found secret masked.

    Null text stays null. ``length_col`` names a column that is to hold the new
    text's length in characters.
    """

    def start():
        scan = scanner(reach, min_bits)

        def clean(text: str | None) -> str | None:
            if text is None:
                return None
            base, novel = scan(text)
            return masked(text, base + novel, mask) if base or novel else text

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [clean(t.as_py()) for t in batch.column(batch.schema.get_field_index(text_col))]
            lengths = {length_col: [None if t is None else len(t) for t in texts]} if length_col else {}
            return with_columns(batch, {text_col: texts} | lengths)

        return one

    return map_whole(docs, start)
