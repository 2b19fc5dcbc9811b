"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; these are the seeds.  A
lexical pattern is the two words before an entity, or the word before and the word after it, where
neighbouring words without letters count as one place, so that a number written with spaces stands in
one place like one without.  A candidate is whatever stands in a place and has a digit or an inner @.

The graph links instances (normalised strings) to the patterns they occur with; it holds every pattern
with ``MIN_SEEDS`` different instances.  Spark scores it in rounds.  A pattern's confidence is the share
of *all* its occurrences in the corpus that trusted instances fill, and it counts once ``MIN_SEEDS``
different trusted instances stand in it.  An instance's trust is 1 - prod(1 - confidence) over its
patterns, seeds being 1, and its kind that of its best pattern.  Instances accepted in one round support
further patterns in the next, which find further instances, until nothing new comes or after
``ROUNDS``.  Accepted instances are added as spans; base spans always stay.

Two narrow passes read the texts.  The first finds seeds and candidates.  The second counts the
occurrences of the graph's patterns; it asks a Bloom filter, sized by their number up to 8 MB, whether a
context may be one of them, and a join by the exact pattern removes what it lets through.  All counts
cover the whole corpus.

Cases: a null or empty text has no spans; very long texts are read whole; repeated rows are rows of
their own; null ids stay; of patterns that tie in confidence the kind listed first counts; an empty
table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import sized, tidied
from corvane.plans.scratch import materialize, release

KINDS = ("email", "ip", "card", "phone")
#: A pattern needs this many different seeds, this confidence; an instance this trust.
MIN_SEEDS, MIN_CONFIDENCE, MIN_TRUST = 3, 0.8, 0.8
ROUNDS = 6
#: The Bloom filter has 16 bits a pattern, and 2 to the power of these at least and at most.
BLOOM_LEAST, BLOOM_MOST = 16, 26
MEMORY_WORDS = 200_000

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MASK = (1 << 64) - 1
_known: dict[str, int] = {}


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Anchored at the sign: the part before it reaches back to the first foreign character or the last match."""
    done = 0
    local = set("._%+-")
    for m in _AT.finditer(text):
        at = start = m.start()
        while start > done and ((c := text[start - 1]).isascii() and c.isalnum() or c in local):
            start -= 1
        if start < at:
            yield start, m.end()
            done = m.end()


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    out = [(0, *s) for s in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(g := p.lstrip("0")) <= 3 and int(g or 0) <= 255 for p in m.groups()):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def _word(token: str) -> int:
    """Number of a context word: its letters in lower case, other signs dropped."""
    n = _known.get(token)
    if n is None:
        if len(_known) > MEMORY_WORDS:
            _known.clear()
        n = _known[token] = xxhash.xxh3_64_intdigest("".join(c for c in token.lower() if c.isalpha()).encode("utf-8", "surrogatepass"))
    return n


_NO_LETTERS = np.uint64(xxhash.xxh3_64_intdigest(b""))


def _places(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of each place, place of each word): neighbouring words without letters share a place."""
    h = np.fromiter(map(_word, words), np.uint64, len(words))
    plain = h == _NO_LETTERS
    first = np.ones(len(h), bool)
    first[1:] = ~(plain[1:] & plain[:-1])
    return h[first], np.cumsum(first) - 1


def _contexts(before2: int, before: int, after: int) -> tuple[int, int]:
    """Numbers of the two patterns around an entity, signed."""
    left = (before2 * 0x9E3779B97F4A7C15 ^ before * 0xC2B2AE3D27D4EB4F) & _MASK
    both = (before * 0x165667B19E3779F9 ^ after * 0x27D4EB2F165667C5 ^ 0x5BD1E995) & _MASK
    return tuple(x - (1 << 64) if x >> 63 else x for x in (left, both))


_EDGE = "struct<kind:int,start:int,end:int,inst:bigint,pats:array<bigint>>"
_EDGE_ARROW = pa.list_(
    pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("inst", pa.int64()), ("pats", pa.list_(pa.int64()))])
)
_may_hold = re.compile(r"[0-9@]").search
_STOPS = ",;:!?"
_EDGES = "\"'`.,;:!?()[]{}<>|*#$%&"


def _candidates(text: str, words: list[re.Match], place: np.ndarray, taken: set[int]) -> Iterator[tuple[int, int]]:
    """Spans of what may be an identifier: words of one place up to a stop, without the words of base spans."""
    j = 0
    while j < len(words):
        last = j
        if j not in taken:
            while last + 1 < len(words) and place[last + 1] == place[j] and last + 1 not in taken and words[last][0][-1] not in _STOPS:
                last += 1
            raw = text[words[j].start() : words[last].end()]
            if _may_hold(raw):
                core = raw.strip(_EDGES)
                if any(map(str.isdigit, core)) or 0 < core.find("@") < len(core) - 1:
                    s = words[j].start() + raw.index(core)
                    yield s, s + len(core)
        j = last + 1


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and candidates with their patterns; a candidate's kind is -1."""
    if not _may_hold(text):
        return []
    words = list(_WORD.finditer(text))
    starts = [w.start() for w in words]
    numbers, place = _places([w[0] for w in words])
    taken = {j for _, s, e in base for j in range(bisect_right(starts, s) - 1, bisect_right(starts, e - 1))}
    found = [*base, *((-1, s, e) for s, e in _candidates(text, words, place, taken))]
    out = []
    number = lambda p: int(numbers[p]) if 0 <= p < len(numbers) else 0
    for k, s, e in found:
        first, last = (int(place[bisect_right(starts, x) - 1]) for x in (s, e - 1))
        plain = "".join(c for c in text[s:e].lower() if c.isalnum())
        inst = xxhash.xxh3_64_intdigest(plain.encode("utf-8", "surrogatepass"))
        pats = _contexts(number(first - 2), number(first - 1), number(last + 1))
        out.append({"kind": k, "start": s, "end": e, "inst": inst - (1 << 64) if inst >> 63 else inst, "pats": list(pats)})
    return out


def _first_pass(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            uid, spans, edges = [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                uid.append(row)
                row += 1
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                edges.append(mentions(text, base))
            span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(uid, pa.int64()), pa.array(spans, span), pa.array(edges, _EDGE_ARROW)],
                names=["doc_id", "uid", "base", "edges"],
            )

    schema = f"doc_id {kind}, uid bigint, base array<struct<kind:int,start:int,end:int>>, edges array<{_EDGE}>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _bloom_places(pats: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    u = pats.view(np.uint64)
    return (u >> np.uint64(64 - bits)).astype(np.int64), ((u * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _filter_words(patterns: DataFrame, bits: int) -> np.ndarray:
    """The Bloom filter's 64-bit words, or-ed in Spark; at most 2**(bits - 6) rows come to the driver."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.concatenate(_bloom_places(batch.column("pat").to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array(every >> 6, pa.int64()), pa.array((np.uint64(1) << (every & 63).astype(np.uint64)).view(np.int64))], names=["word", "bit"])

    table = patterns.select("pat").mapInArrow(places, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    if table.num_rows:
        out[table["word"].to_numpy()] = table["bits"].to_numpy()
    return out


def _occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pat, n_all): all places of the corpus where the context of a pattern occurs."""
    spark = docs.sparkSession
    known = patterns.count()
    if not known:
        return spark.createDataFrame([], "pat bigint, n_all bigint")
    bits = min(BLOOM_MOST, max(BLOOM_LEAST, (16 * known - 1).bit_length()))
    sent = spark.sparkContext.broadcast(_filter_words(patterns, bits))

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(sent.value.view(np.uint8), bitorder="little").view(bool)
        c = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x5BD1E995)]
        for batch in batches:
            met = []
            for text in batch.column("text"):
                numbers, _ = _places(_WORD.findall(text.as_py() or ""))
                h = np.zeros(len(numbers) + 3, np.uint64)  # two words of nothing before, one after
                h[2:-1] = numbers
                before2, before, after = h[:-3], h[1:-2], h[3:]
                both = np.concatenate([before2 * c[0] ^ before * c[1], before * c[2] ^ after * c[3] ^ c[4]]).view(np.int64)
                one, two = _bloom_places(both, bits)
                met.append(both[held[one] & held[two]])
            pats, n = np.unique(np.concatenate(met) if met else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pats, pa.int64()), pa.array(n, pa.int64())], names=["pat", "n"])

    counted = docs.select("text").mapInArrow(count, "pat bigint, n bigint")
    return counted.groupBy("pat").agg(F.sum("n").alias("n_all"))


def extract(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, base, added) of each row: spans as (kind number, start, end), code points, end exclusive."""
    rows = materialize(_first_pass(docs), "mentions")
    edges = rows.select("uid", F.inline("edges")).select("uid", "kind", "start", "end", "inst", F.explode("pats").alias("pat"))
    links = edges.groupBy("pat", "inst").agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("n"))
    links = materialize(links, "links")
    patterns = materialize(links.groupBy("pat").agg(F.count(F.lit(1)).alias("several"), F.sum("n").alias("own")).where(F.col("several") >= MIN_SEEDS), "patterns")
    # an entity that takes several places is not among the counted ones
    counted = patterns.join(_occurrences(docs, patterns), "pat", "left").select("pat", F.greatest("own", F.coalesce("n_all", F.lit(0))).alias("n_all"))
    counted = materialize(counted, "patterns")
    graph = materialize(links.join(counted, "pat"), "graph")
    release(links, patterns, counted)
    # the kind of an instance that is a seed somewhere is the seed's
    seeds = materialize(graph.where("kind >= 0").groupBy("inst").agg(F.max("kind").alias("kind"), F.lit(1.0).alias("trust")), "seeds")
    trusted, confident, before = seeds, None, None
    for _ in range(rounds):
        good = F.col("trust") >= MIN_TRUST
        filled = graph.select("pat", "inst", "n", "n_all").join(sized(trusted), "inst")
        scored = filled.groupBy("pat").agg(
            F.count(F.when(good, 1)).alias("support"),
            # rounded, so that the order of a sum decides nothing
            F.round(F.sum(F.col("n") * F.col("trust")) / F.first("n_all"), 6).alias("confidence"),
            F.mode("kind", True).alias("p_kind"),
        )
        older = confident
        confident = materialize(scored.where((F.col("support") >= MIN_SEEDS) & (F.col("confidence") >= MIN_CONFIDENCE)).select("pat", "confidence", "p_kind"), "confident")
        doubt = F.sum(F.log(1 - F.least("confidence", F.lit(1 - 1e-9))))
        best = F.max_by("p_kind", F.struct("confidence", -F.col("p_kind")))
        grown = graph.select("pat", "inst").join(sized(confident), "pat").groupBy("inst").agg(best.alias("kind"), F.round(1 - F.exp(doubt), 6).alias("trust"))
        grown = grown.join(sized(seeds.select("inst")), "inst", "left_anti")
        later = materialize(seeds.unionByName(grown.select("inst", "kind", "trust")), "trust")
        release(*(t for t in (older, trusted if trusted is not seeds else None) if t is not None))
        trusted = later
        now = tuple(trusted.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(inst, kind, trust) as decimal(38, 0)))")).first())
        if now == before:
            break
        before = now
    accepted = materialize(trusted.where(F.col("trust") >= MIN_TRUST).select("inst", "kind"), "accepted")
    new = edges.where("kind < 0").drop("kind").join(sized(confident.select("pat")), "pat", "left_semi").join(sized(accepted), "inst")
    added = new.groupBy("uid", "start", "end").agg(F.min("kind").alias("kind")).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return rows.join(added, "uid", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")

    def of(k: int):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    every = F.sort_array(F.concat("base", "added"))
    return found.select(
        "doc_id",
        *map(of, range(len(KINDS))),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
