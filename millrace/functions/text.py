"""Chunks, sparse terms and checks of text, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Structural words that term vectors leave out.
STOP_WORDS = (
    "a am an and any are as at be but by can do does for from had has have he her him his how if in into is it its me my no not "
    "of on or our out she so than that the their them then they this to too up us via was we were what when where who why you your"
).split()
#: Fixed values of 32-bit FNV-1a, of which the buckets need the low 16 bits.
FNV_START, FNV_PRIME, BUCKETS = 2_166_136_261 % 65_536, 16_777_619 % 65_536, 65_536


def bucket(term: Column) -> Column:
    """FNV-1a of the lower-cased ASCII term modulo BUCKETS."""
    codes = F.transform(F.split(F.lower(term), ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(FNV_START), lambda h, b: (h.bitwiseXOR(b) * FNV_PRIME) % BUCKETS)


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Terms whose bucket a worker remembers.
MOST_TERMS = 200_000
#: Bytes of text that a worker takes from a batch at a time, but for a longer single row.
PIECE_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch, columns: Sequence[str], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `most` bytes of text in all of the columns; a row is never cut."""
    size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    at = 0
    for cut in [*(np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1).tolist(), batch.num_rows]:
        if cut > at:
            yield batch.slice(at, cut - at)
        at = cut


def _bucket_of(term: bytes) -> int:
    h = FNV_START
    for b in term:
        h = (h ^ b) * FNV_PRIME % BUCKETS
    return h


def term_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, buckets, counts, weights) of each row: terms are ASCII alphanumeric runs of 3 or more, no stop words, lower-cased; the weight of a
    bucket is ln(1 + its count). Terms are counted where the text is read: nothing is shuffled. A null text has no terms."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, buckets array<int>, counts array<long>, weights array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = {w.encode() for w in STOP_WORDS}
        known: dict[bytes, int] = dict.fromkeys(stop, -1)
        for batch in (part for whole in batches for part in pieces(whole, ["text"])):
            found = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                terms = [t for t in (text or b"").translate(_LOWER).split() if len(t) >= 3]
                for t in set(terms).difference(known):
                    if len(known) >= MOST_TERMS:
                        break
                    known[t] = _bucket_of(t)
                numbers = np.fromiter((known[t] if t in known else _bucket_of(t) for t in terms), np.int32, len(terms))
                found.append(np.unique(numbers[numbers >= 0], return_counts=True))
            ends = np.concatenate(([0], np.cumsum([len(b) for b, _ in found]))).astype(np.int32)
            buckets, counts = (np.concatenate([f[k] for f in found] or [np.empty(0, np.int64)]) for k in (0, 1))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v, t)) for v, t in ((buckets, pa.int32()), (counts, pa.int64()), (np.log1p(counts), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=[id_col, "buckets", "counts", "weights"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def term_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bucket, tf, weight): a row for each bucket of term_lists."""
    each = term_lists(docs, id_col, text_col).select(id_col, F.explode(F.arrays_zip("buckets", "counts", "weights")).alias("e"))
    return each.select(id_col, F.col("e.buckets").alias("bucket"), F.col("e.counts").alias("tf"), F.col("e.weights").alias("weight"))


def windows(text: Column, most: int = 2000, most_bytes: int = 4096) -> Column:
    """A text cut at `most` characters or before the one that would make more than most_bytes, whichever comes first."""
    short = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / most).cast("int")), lambda i: F.substring(text, i * most + 1, F.lit(most)))
    begin = F.struct(F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(0).alias("bytes"), F.array().cast("array<struct<start:int,n:int>>").alias("done"))

    def cut(s: Column) -> Column:
        return F.concat(s["done"], F.array(F.struct(s["start"].alias("start"), s["n"].alias("n"))))

    def step(s: Column, size: Column) -> Column:
        full = (s["n"] > 0) & ((s["bytes"] + size > most_bytes) | (s["n"] + 1 > most))
        return F.struct(
            F.when(full, s["start"] + s["n"]).otherwise(s["start"]).alias("start"),
            F.when(full, 1).otherwise(s["n"] + 1).alias("n"),
            F.when(full, size).otherwise(s["bytes"] + size).alias("bytes"),
            F.when(full, cut(s)).otherwise(s["done"]).alias("done"),
        )

    sizes = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), 0), F.octet_length)
    spans = F.aggregate(sizes, begin, step, lambda s: F.filter(cut(s), lambda x: x["n"] > 0))
    by_bytes = F.transform(spans, lambda x: F.substring(text, x["start"] + 1, x["n"]))
    # characters of two bytes at most cannot reach the limit of bytes first
    narrow = (F.octet_length(text) <= most_bytes) | (F.lit(2 * most <= most_bytes) & ~text.rlike("[^\\x{0}-\\x{7FF}]"))
    return F.when(narrow, short).otherwise(by_bytes)


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2000, most_bytes: int = 4096) -> DataFrame:
    """(id, chunk_index, chunk_text): trimmed paragraphs between blank lines, cut at `most` characters or most_bytes, in order."""
    parts = F.filter(F.transform(F.split(text_col, r"\n[ \t\r]*\n"), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")
    return docs.select(id_col, F.posexplode(F.flatten(F.transform(parts, lambda p: windows(p, most, most_bytes)))).alias("chunk_index", "chunk_text"))


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line) of each line that is not blank, numbered from 1 among all lines."""
    each = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("at", "line"))
    return each.where(F.trim("line") != "").select(id_col, (F.col("at") + 1).alias("line_no"), "line")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character."""
    chars = F.split(text, "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.length(text)
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


#: Fixed values of the reference's detectors: what marks a secret in lower-cased text, and how bare tokens begin.
SECRET_FRAGMENTS = ["authorization:", "proxy-authorization:", "bearer ", "cookie:", "set-cookie:", "api_key=", "apikey=", "api-key:", "x-api-key:", "access_token=", "refresh_token=", "secret_key=", "token=", "adapter_response"]
BARE_PREFIXES = ["sk-proj-", "github_pat_", "sk-", "sk_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xoxb-", "xoxp-", "glpat-"]


#: Keys of further services, which only redaction looks for.
TOKEN_PREFIXES = ["sk-", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "AKIA", "AIza", "hf_", "npm_"]


def cookie_string(text: Column) -> Column:
    """Two or more segments between semicolons, each key=value or a flag, with a value of 16 bytes or more."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")
    pair, size = r"(?U)^[A-Za-z0-9_-]+=\S+\z", lambda s: F.octet_length(F.regexp_replace(s, "^[^=]*=", ""))
    shaped = F.forall(parts, lambda s: s.rlike(pair) | s.rlike(r"^[A-Za-z0-9]+\z"))
    return text.contains(";") & text.contains("=") & (F.size(parts) >= 2) & shaped & F.exists(parts, lambda s: s.contains("=") & (size(s) >= 16))


def marked_secret(text: Column) -> Column:
    """Whether text has a fragment that marks a secret, a dotenv line, or a bare token of 20 characters after its prefix."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.lit(False)
    for fragment in SECRET_FRAGMENTS:
        found |= lower.contains(fragment)
    return (
        found
        | text.rlike(r"(?Udm)^[^\S\n]*[A-Z_][A-Z0-9_]*[^\S\n]*=[^\S\n]*\S")
        | text.rlike(f"(?<![A-Za-z0-9_-])(?:{'|'.join(BARE_PREFIXES)})[A-Za-z0-9_-]{{20}}")
    )


def contains_secret(text: Column) -> Column:
    """Whether text has a secret by the reference's detectors: what marks one, a private key block, an address with user and password,
    or a cookie string."""
    return (
        marked_secret(text)
        | text.rlike("-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----")
        | text.rlike(r"(?U)[A-Za-z][A-Za-z0-9+.\-]*://[^\s/:@]+:[^\s/@]+@[^\s/]+")
        | cookie_string(text)
    )


#: Shapes that are redacted whatever their entropy. A marker's run is entered at its start or after the last match alone,
#: where a match from the left would begin, so long runs without a marker are read once.
STRUCTURED = r"""(?xU)
  AIza[0-9A-Za-z_\-]{35}
| ya29\.[\w\-]+
| \bsk-[A-Za-z0-9][A-Za-z0-9_\-]*
| \bgh[pousr]_[A-Za-z0-9]+
| \batk_[A-Za-z0-9_\-]+
| (?i:authorization)[:=][\ \t]*(?:(?i:bearer|basic|token)[\ \t]+)?\S*
| (?:(?<!\S)|\G)\S*(?i:API_KEY|TOKEN|SECRET)[:=]\S*
"""
RUN, LEAST_ENTROPY = "[A-Za-z0-9_-]", 3.0


def redact(text: Column, services: bool = False) -> Column:
    """Secrets replaced by [REDACTED]: structured shapes, then runs of 32 or more characters with 3 bits of entropy each; with services also
    keys of further services, passwords in addresses and bearer tokens, which the reference leaves."""
    out = F.regexp_replace(text, STRUCTURED, "[REDACTED]")
    pieces = F.split(out, f"(?<!{RUN})(?={RUN}{{32}})|(?<={RUN}{{32}})(?!{RUN})")
    hide = lambda p: F.when(p.rlike(rf"^{RUN}{{32,}}\z") & (entropy(p) >= LEAST_ENTROPY), F.lit("[REDACTED]")).otherwise(p)
    out = F.when(out.rlike(f"{RUN}{{32}}"), F.array_join(F.transform(pieces, hide), "")).otherwise(out)
    if not services:
        return out
    prefix = "|".join(sorted(TOKEN_PREFIXES, key=len, reverse=True))
    out = F.regexp_replace(out, f"(?<![A-Za-z0-9_-])(?:{prefix})[A-Za-z0-9_-]{{16,}}", "[REDACTED]")
    out = F.regexp_replace(out, r"([A-Za-z][A-Za-z0-9+.-]*://)[^\s/:@]+:[^\s/@]+@", "$1[REDACTED]@")
    return F.regexp_replace(out, r"(?i)\b(bearer\s+)[A-Za-z0-9._-]{16,}", "$1[REDACTED]")


def squeeze(text: Column) -> Column:
    """Three or more newlines become two, runs of spaces and tabs one space."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")


#: Headings that structure a context; a chunk must not forge them.
CONTEXT_HEADINGS = ["Sources", "Source Document", "Top Chunk", "Supplemental Chunk"]


def defang(text: Column) -> Column:
    """Source marks and headings of a context lose their meaning in quoted text by a zero-width space."""
    for name in CONTEXT_HEADINGS:
        text = F.replace(text, F.lit(f"## {name}"), F.lit(f"## \u200b{name}"))
    return F.regexp_replace(text, r"\[S([0-9]+)\]", "[\u200bS$1]")


def cited(answer: Column) -> Column:
    """Distinct source numbers that an answer cites, in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[S(\d+)\]"), 1))


#: Marks of pages that stand between a reader and the page asked for, with the size in bytes below which they count.
CHALLENGES = [
    ("akamai", ["bazadebezolkohpepadr"], None),
    ("cloudflare", ["_cf_chl_opt"], None),
    ("cloudflare", ["challenge-platform/h/"], None),
    ("cloudflare", ["just a moment", "cf-spinner"], None),
    ("cloudflare", ["checking your browser", "cf-spinner"], None),
    ("cloudflare", ["cf-turnstile"], 100_000),
    ("cloudflare", ["challenges.cloudflare.com/turnstile"], 100_000),
    ("datadome", ["geo.captcha-delivery.com"], None),
    ("datadome", ["captcha-delivery.com/captcha"], None),
    ("aws_waf", ["awswaf-captcha"], None),
    ("aws_waf", ["aws-waf-client-browser"], None),
    ("aws_waf", ["interstitial-spinner", "verifying your connection"], 10_000),
    ("hcaptcha", ["hcaptcha.com", "h-captcha"], 50_000),
]


def challenge(body: Column, most_bytes: int = 150 << 10, head: int = 50_000) -> Column:
    """Who blocks the reader, or null. Pages beyond most_bytes are judged by their first `head` characters, as challenges are short."""
    size = F.octet_length(body)
    low = F.lower(F.when(size <= most_bytes, body).otherwise(F.substring(body, 1, head)))
    out = F.lit(None).cast("string")
    for vendor, marks, below in reversed(CHALLENGES):
        test = F.lit(True) if below is None else size < below
        for mark in marks:
            test &= low.contains(mark)
        out = F.when(test, vendor).otherwise(out)
    return out


def meta_description(page: Column) -> Column:
    """What the head's description says, from the first 8192 characters where the head has no end; null without one."""
    ended = F.regexp_extract(page, r"(?s)^(.*?)</(?:head|HEAD)>", 1)
    head = F.when(page.rlike(r"</(?:head|HEAD)>"), ended).otherwise(F.substring(page, 1, 8192))
    pattern = r"(?is)name=\"description\".*?content=\"([^\"]*)\""
    return F.when(head.rlike(pattern), F.regexp_extract(head, pattern, 1))


def links(page: Column) -> Column:
    """Absolute addresses of the page's anchors, in order, once each."""
    anchors = F.regexp_extract_all(page, F.lit(r"<a[ \t\n\r][^>]*>"), 0)
    found = F.flatten(F.transform(anchors, lambda a: F.regexp_extract_all(a, F.lit(r"href=\"([^\"]*)\""), 1)))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x.startswith("http://") | x.startswith("https://")))


def env_keys(lines: Column) -> Column:
    """struct(key, secret, has_default) of each KEY=value line; the value itself is never given."""
    pattern = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=(.*)$"
    name = F.regexp_extract(lines, pattern, 1)
    secret = F.lower(name).rlike("secret|password|token|api_key|apikey|private_key|database_url")
    return F.when(lines.rlike(pattern), F.struct(name.alias("key"), secret.alias("secret"), (F.trim(F.regexp_extract(lines, pattern, 2)) != "").alias("has_default")))


def markdown_links(text: Column) -> Column:
    """http(s) targets of Markdown links in order, repeats kept, without fragments."""
    found = F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(\s*(https?://[^\s)#]*)"), 1)
    return found
