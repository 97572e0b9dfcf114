"""Secret scan by dictionary-primed compression novelty.

A candidate is the body of a private key block; the value (of MIN_VALUE
characters or more) assigned to a sensitive name (token, password, api key,
...), whole, with the signs it has; or a run of at least MIN_LENGTH token
characters whose left context names something sensitive, or in which a known
kind of key begins after a separator.  Values of letters only count when quoted
or alone on their line, values of several words when they hold a digit.  A zstandard compressor is primed with a
dictionary of common identifiers and with the text around the candidate,
without copies of the candidate itself; the bytes that the candidate adds to
an empty frame are its novelty.  Names, paths and words repeated nearby cost
few bytes; keys cost nearly their own length.  A candidate is reported when
novel bytes / length reaches MIN_NOVELTY, or novel bytes reach MIN_RANDOM of
what a random string of its alphabet and length costs (entropy coding halves
long hex).  Letters and digits must be mixed in a run.

Defined results: null ids stay null in the report; null and empty texts report
nothing; texts are scanned whole; the same secret twice in a text is reported
twice; a repeated row is scanned again; the report holds a digest, never the
secret; other columns are ignored (findings) or kept (redacted).
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

MIN_LENGTH, MIN_NOVELTY, MIN_RANDOM = 16, 0.7, 0.9
#: From narrow to wide: a candidate is measured against the first that holds it.
ALPHABETS = tuple(
    (re.compile(f"[{x}]*"), y)
    for x, y in (
        ("0-9a-f", "0123456789abcdef"), ("0-9A-F", "0123456789ABCDEF"), ("A-Z2-7=", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("a-z2-7=", "abcdefghijklmnopqrstuvwxyz234567"), ("0-9a-z", "0123456789abcdefghijklmnopqrstuvwxyz"),
        ("0-9A-Z", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"\s\S", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/"),
    )
)
#: Characters on the left, blanks before the candidate apart, in which a name must stand; characters on each side that prime the compressor.
REACH, AROUND = 48, 512
MIN_VALUE = 6
MASK = "[SECRET]"
CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-.~]{%d,}={0,2}" % MIN_LENGTH)
SENSITIVE = re.compile(
    r"(?i)(?:api|access|private|secret|signing|encryption|account|storage|ssh)[ _-]?key|secret|token|passw(?:or)?d|passphrase|\bpwd\b|credential|authori[sz]ation|\bbearer\b|client[ _-]?id|session[ _-]?id|webhook|connection[ _-]?string"
)
KNOWN = re.compile(r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk_live_|rk_live_|sk-|xox[abprs]-|eyJ|AIza|ya29\.|SG\.|npm_|hf_")
INSIDE = re.compile(rf"(?<![A-Za-z0-9])(?:{KNOWN.pattern})")
BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----((?:(?!-----BEGIN ).)*?(?=-----END )|(?:(?:\s|\\[rn])*[A-Za-z0-9+/=]{16,})*)", re.S)
ASSIGNED = re.compile(
    f"(?i)(?:{SENSITIVE.pattern[4:]})" + r"""(?:[_-]?(?:key|value|text|string))?\d*\\?["'\]]*[ \t]*(?:=>|:=|==?|:)[ \t]*(?:(?P<quote>["'`])(?P<quoted>(?:\\.|(?!(?P=quote))[^\\\n])*)(?P=quote)|(?P<plain>[^\s"'`]+))"""
)
SIGN = re.compile("[=:]")
#: Values that name where a secret is kept: calls, variables, placeholders.
REFERENCE = re.compile(r"[\w.]+[(\[].*|\$\{?[A-Za-z_]\w*\}?|\$\(.*|<[^>]*>|\{.*\}|%\(?\w+\)?s?|[A-Za-z]\w*(?:\.[A-Za-z_]\w*)+", re.S)
IDENTIFIERS = (
    "abstract access account action address admin algorithm allowed analytics android application argument array assert async attribute authenticate authentication authenticator authorization authorize "
    "background base64 batch binary boolean branch browser buffer builder bytes cache callback certificate channel character checkpoint checksum class client cluster collection column command comment commit "
    "component compress config configuration connection console constant constructor container content context controller convert cookie counter create credential credentials current customer dashboard data database "
    "dataset datetime debug decode decorator default delete dependency description destination developer development device dictionary digest directory document documentation domain download driver duration dynamic "
    "element email enable encode encoding encrypt endpoint engine entity environment error event example exception execute executor expected expire expired export extension external factory failed feature "
    "field filename filter final format framework function gateway generate generator global group handler handle header helper history hostname identifier identity ignore image implementation import index "
    "information initialize input insert instance integer integration interface internal iterator javascript keyboard language length level library license limit listener loader local location logger logging login "
    "manager mapping message metadata method metrics middleware migration missing mode model module monitor namespace network notification number object operation optional option organization output override package "
    "parameter parent parse parser partition password path pattern payload performance permission pipeline placeholder platform plugin pointer policy position prefix private process processor production profile project "
    "property protected protocol provider proxy public python query queue random reader record recursive redirect reference refresh register registry release remote remove repository request required reset resolve resource "
    "response result return revision route router runtime sandbox schedule schema scope script search secret secrets section security select selector sequence serialize serializer server service session setting settings "
    "signature signing snapshot source stack staging standard state statement static status storage stream string structure submit subscription success suffix support switch symbol system table template temporary tenant "
    "thread timeout timestamp token tokenizer tokens tracking transaction transform transport trigger tuple type undefined unique update upload username validate validation validator value variable vendor verify version "
    "virtual visible warning webhook widget window worker workflow wrapper writer YOUR_API_KEY YOUR_TOKEN_HERE xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "https://www.example.com/ http://localhost:8080/api/v1/ org.apache.commons java.util.concurrent node_modules/ src/main/ /usr/local/lib/ .github/workflows/ application/json charset=utf-8"
).encode()
_parameters = zstandard.ZstdCompressionParameters.from_level(19, write_content_size=False, write_checksum=False, write_dict_id=False)
_plain = len(zstandard.ZstdCompressor(compression_params=_parameters).compress(b""))


def novel_bytes(candidate: str, around: str) -> int:
    """Compressed bytes that the candidate adds when identifiers and its surroundings are known."""
    primer = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + around.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packed = zstandard.ZstdCompressor(compression_params=_parameters, dict_data=primer).compress(candidate.encode())
    return max(0, len(packed) - _plain)


@lru_cache(4096)
def random_bytes(alphabet: str, length: int) -> int:
    """Novel bytes of a random string."""
    return novel_bytes("".join(random.Random(length).choices(alphabet, k=length)), "")


def novel(n: int, word: str) -> bool:
    """Whether n novel bytes are as many as a key like word has."""
    return n >= MIN_NOVELTY * len(word) or n >= MIN_RANDOM * random_bytes(next(y for x, y in ALPHABETS if x.fullmatch(word)), len(word))


def _around(text: str, a: int, e: int) -> str:
    around, word = text[max(0, a - AROUND) : a] + " " + text[e : e + AROUND], text[a:e]
    if word in around:  # whole copies don't make a secret known; a longer name that holds it does
        around = re.sub(rf"(?<![A-Za-z0-9+/_\-~]){re.escape(word)}(?![A-Za-z0-9+/_\-~])", " ", around)
    return around


def blocks(text: str):
    """(first and last character, what names it, what is measured) of private key blocks."""
    for m in BLOCK.finditer(text) if "PRIVATE KEY" in text else ():
        body = m[1]
        a = m.start(1) + len(body) - len(body.lstrip())
        if word := re.sub(r"\s|\\[rn]", "", body):
            yield a, a + len(body.strip()), "private key", word


def values(text: str):
    """The same of values assigned to a sensitive name."""
    past = 0
    for sign in SIGN.finditer(text):  # few: most texts are never searched for names
        at = sign.start()
        if at < past:
            continue
        while at > past and text[at - 1] in " \t":
            at -= 1
        named = None
        for named in SENSITIVE.finditer(text, max(past, at - REACH), at):
            pass  # the nearest
        m = named and ASSIGNED.match(text, named.start())
        if not m:
            continue
        past = m.end()
        kind = "quoted" if m["quote"] else "plain"
        a, e = m.span(kind)
        if kind == "plain":
            while e > a and text[e - 1] in ".,;:)]}?>":
                e -= 1
        word = text[a:e]
        if e - a < MIN_VALUE or REFERENCE.fullmatch(m[kind]):
            continue
        if not any(map(str.isdigit, word)):
            alone = not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].replace("export", "").strip(" \t_-.ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") and text[m.end() : m.end() + 1] in ("", "\n", "\r")
            if any(map(str.isspace, word)) or kind == "plain" and not (alone and e == m.end()):
                continue
        yield a, e, SENSITIVE.match(text, m.start()).group().lower(), word


def secrets(text: str) -> list[tuple[int, int, str, int, float]]:
    """(first and last character, what names it, novel bytes, novelty) of each secret."""
    out: list = []
    for found in (blocks, values, runs):
        taken = [x[:2] for x in out]
        for a, e, name, word in found(text):
            if any(a < y and x < e for x, y in taken):
                continue
            n = novel_bytes(word, _around(text, a, e))
            if novel(n, word):
                out.append((a, e, name, n, round(n / len(word), 4)))
    return sorted(out)


def runs(text: str):
    """The same of runs near a sensitive name, or with a known kind of key."""
    for m in CANDIDATE.finditer(text):
        a, e = m.span()
        while e > a and text[e - 1] in ".-~":  # the end of a sentence
            e -= 1
        word = text[a:e]
        if e - a < MIN_LENGTH or not (any(map(str.isdigit, word)) and any(map(str.isalpha, word))):
            continue
        left = a
        while left and text[left - 1] in " \t":  # blanks don't count for the reach
            left -= 1
        named = None
        for named in SENSITIVE.finditer(text, max(0, left - REACH), left):
            pass  # the nearest
        known = KNOWN.match(word)
        if named or known:
            yield a, e, (named or known).group().lower(), word
        elif known := next((k for k in INSIDE.finditer(word) if len(word) - k.start() >= MIN_LENGTH), None):
            yield a + known.start(), e, known.group().lower(), word[known.start() :]


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, context, novel_bytes, novelty, digest), one row a secret."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("context", pa.string()), ("novel_bytes", pa.int32()), ("novelty", pa.float64()), ("digest", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += [(doc, *s, hashlib.sha256(text[s[0] : s[1]].encode()).hexdigest()[:16]) for s in secrets(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return arrow_map(rows, run, "doc_id long, start int, end int, context string, novel_bytes int, novelty double, digest string")


def mask(text: str | None) -> str | None:
    for a, e, *_ in reversed(secrets(text)) if text else ():
        text = text[:a] + MASK + text[e:]
    return text


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every secret replaced by MASK and n_chars brought up to date; all rows and columns stay."""

    def run(batches):
        for b in batches:
            old = b.column("text").to_pylist()
            new = [mask(t) for t in old]
            if any(x is not y for x, y in zip(old, new)):
                b = b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), pa.array(new, b.schema.field("text").type))
                if "n_chars" in b.schema.names:
                    kind = b.schema.field("n_chars")
                    count = [n if x is y else len(y) for n, x, y in zip(b.column("n_chars").to_pylist(), old, new)]
                    b = b.set_column(b.schema.get_field_index("n_chars"), kind, pa.array(count, kind.type))
            yield b

    return arrow_map(docs, run, docs.schema)
