"""Texts that lost their end when they were stored or sent."""

from __future__ import annotations

import hashlib
import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.operators.small import without_repeats
from chartloom.session import cut

#: Occurrences from which a word or a run of words is known.
KNOWN = 3
#: The same as a share of the occurrences of the words that begin with it: in a large corpus stubs occur too.
KNOWN_SHARE = 0.001
#: Share of a run's occurrences that end a sentence or line, below which a text that stops there is cut.
RARELY_ENDS = 0.1
#: The same where the source marked the place or the text is as long as its source allows.
SUSPECT_ENDS = 0.5
#: Share of a word's occurrences that end a sentence or line, below which an item of a list can't end with it.
ITEM_ENDS = 0.02
#: Words of a line that may be such an item, and the share of lines begun alike that are as short.
ITEM_WORDS, ITEM_SHARE = 8, 0.9
#: No more than this share of texts is thought cut. A run at which SURELY times more texts end than such
#: cuts would leave there by chance is an ending.
CUT_SHARE, SURELY = 0.1, 5
#: Share of texts that end with a run, from which it is an ending though it goes on elsewhere or looks like half a word.
USUAL_SHARE = 0.002
#: Share of a source's texts that have exactly its greatest length, from which that is a limit.
LIMIT_SHARE = 0.01
#: Bits of the filter of runs at texts' ends for each distinct run, and least and most of all, as powers of two.
BITS_A_RUN, FILTER_BITS = 16, (16, 28)
#: Runs counted in a worker before they are merged, and spelled words it holds before they are handed on.
HELD_RUNS, HELD_WORDS = 1_500_000, 500_000

#: What sources put behind a cut, besides ellipses and replacement characters.
MARK = re.compile(r"[\[(<]\s?(?:truncated|cut(?: off)?|continued|cont(?:'d|\.)?|more|snip|\.\.\.|…)\s?[\])>]\Z", re.IGNORECASE)
#: Stands before each line twice, so that a run of three at its beginning is one of that line alone.
_BEGIN = "\x02"
_TOKEN = re.compile(r"[^\W\d_]+|9+|[.!?]\x1e|\n|[^\w\s]").findall
_ASCII_TOKEN = re.compile(r"[a-z]+|9+|[.!?]\x1e|\n|[^\w\s]").findall
_COMBINING = re.compile(r"[̀-ͯﬀ-ﬆ]")
_DECIMALS = re.compile(r"\d")
_MASK = (1 << 64) - 1


def base(text: str) -> tuple[str, bool]:
    """The text without what follows its last sign, and whether that marks a cut."""
    rest, marked = text, False
    while True:
        plain = rest.rstrip()
        bare = plain.rstrip("�…")
        if bare.endswith("..."):
            bare = bare.rstrip(".")
        elif bare[-1:] in ("]", ")", ">") and (m := MARK.search(bare[-20:])):
            bare = bare[: len(bare) - len(m[0])]
        if bare == rest:
            return rest, marked
        rest, marked = bare, marked or bare != plain


def _prepared(text: str) -> str:
    """Lower case, numbers by their shape, full stops before white space told from those within numbers."""
    text = text.lower()
    if not text.isascii() and _COMBINING.search(text):
        text = unicodedata.normalize("NFKC", text)
    text = _DECIMALS.sub("9", text.replace(_BEGIN, " ")) + "\n"
    for stop in ".!?":
        if stop in text:
            for space in " \n\r\t":
                text = text.replace(stop + space, stop + "\x1e" + space)
    return text


def tokens(line: str) -> list[str]:
    """Words, numbers and signs of a line."""
    return _split(_prepared(line))[:-1]


def _split(prepared: str) -> list[str]:
    return _ASCII_TOKEN(prepared) if prepared.isascii() else _TOKEN(prepared)


class _Hashes(dict):
    """64 bit hashes of tokens, the same in every worker."""

    def __missing__(self, token: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        self[token] = h = int.from_bytes(hashlib.blake2b(token.encode("utf-8", "replace"), digest_size=8).digest(), "big")
        return h


_hashes = _Hashes()
_END, _START = _hashes["\n"], _hashes[_BEGIN]


def mixed(*hashes):
    """One key of several hashes, of numbers or of arrays of them."""
    array = isinstance(hashes[0], np.ndarray)
    odd, k = 0x9E3779B97F4A7C15, 0xCBF29CE484222325 + len(hashes)
    if array:
        k = np.full(len(hashes[0]), k, np.uint64)
        for h in hashes:
            k = (k ^ h) * np.uint64(odd)
            k ^= k >> np.uint64(29)
        return k
    for h in hashes:
        k = ((k ^ h) * odd) & _MASK
        k ^= k >> 29
    return k


def _signed(k: int) -> int:
    return k - (1 << 64) if k >> 63 else k


def ending(text: str) -> tuple[bool, str, int, list[int], int | None] | None:
    """(marked, last token, tokens of the last line, keys of the last one, two and three tokens and of the line's
    beginning, key of the last three were the stop within a number)."""
    rest, marked = base(text)
    if not rest:
        return None
    last = tokens(rest[rest.rfind("\n") + 1 :])
    if not last:
        return None
    a, b, c = (_hashes[t] for t in [_BEGIN, _BEGIN, *last][-3:])
    alt = _signed(mixed(a, b, _hashes["."])) if last[-1] == ".\x1e" and len(last) > 1 and last[-2][0] == "9" else None
    opening = mixed(_START, _hashes[last[0]], _hashes[last[1]] if len(last) > 1 else _END, _START)
    return marked, last[-1], len(last), [_signed(k) for k in (mixed(c), mixed(b, c), mixed(a, b, c), opening)], alt


class _Tally:
    """Keys with three counts each, merged as they come."""

    def __init__(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.counts = np.empty((3, 0), np.int64)
        self.new: list[tuple[np.ndarray, int]] = []
        self.held = 0

    def add(self, keys: np.ndarray, which: int) -> None:
        self.new.append((keys, which))
        self.held += len(keys)
        if self.held > HELD_RUNS:
            self.merge()

    def merge(self) -> None:
        arrays = [self.keys, *(k for k, _ in self.new)]
        keys, place = np.unique(np.concatenate(arrays), return_inverse=True)
        counts = np.zeros((3, len(keys)), np.int64)
        at = len(self.keys)
        for i in range(3):
            counts[i] += np.bincount(place[:at], self.counts[i], len(keys)).astype(np.int64)
        for k, which in self.new:
            counts[which] += np.bincount(place[at : at + len(k)], minlength=len(keys))
            at += len(k)
        self.keys, self.counts, self.new, self.held = keys, counts, [], 0


def _counted(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Occurrences of words (kind 1), of runs of two and three tokens that the filter may hold, how many of
    them end a line or sentence, and how many words a full stop follows; lines by their beginning (kind 4),
    and how many of them are short."""
    tallies = {kind: _Tally() for kind in (1, 2, 3, 4)}
    spelled: dict[int, str] = {}
    low = np.uint64(len(bits) * 64 - 1)
    stop_hashes = np.array([_hashes[s + "\x1e"] for s in ".!?"], np.uint64)

    def asked(k: np.ndarray) -> np.ndarray:
        return (bits[(k & low) >> np.uint64(6)] >> (k & np.uint64(63)) & np.uint64(1)).astype(bool)

    def count(texts: list[str]) -> None:
        parts = [_split(f"{_BEGIN}{_BEGIN}" + _prepared(base(t)[0]).replace("\n", f"\n{_BEGIN}{_BEGIN}")) for t in texts]
        flat = list(itertools.chain.from_iterable(parts))
        h = np.fromiter(map(_hashes.__getitem__, flat), np.uint64, len(flat))
        for token in set(flat):
            spelled.setdefault(mixed(_hashes[token]), token)
        new_line = h == np.uint64(_END)
        at = np.nonzero(~new_line & (h != np.uint64(_START)))[0]
        if not len(at):
            return
        stop = (h == stop_hashes[0]) | (h == stop_hashes[1]) | (h == stop_hashes[2])
        last = new_line[at + 1] | stop[at]
        one = mixed(h[at])
        tallies[1].add(one, 0)
        tallies[1].add(one[last], 1)
        tallies[1].add(one[stop[at + 1]], 2)
        for kind, k in ((2, mixed(h[at - 1], h[at])), (3, mixed(h[at - 2], h[at - 1], h[at]))):
            wanted = asked(k)
            tallies[kind].add(k[wanted], 0)
            tallies[kind].add(k[wanted & last], 1)
        ends = np.nonzero(new_line)[0]
        begins = np.concatenate([[2], ends[:-1] + 3])
        full = ends > begins
        begins, sizes = begins[full], (ends - begins)[full]
        k = mixed(np.full(len(begins), _START, np.uint64), h[begins], h[begins + 1], np.full(len(begins), _START, np.uint64))
        wanted = asked(k)
        tallies[4].add(k[wanted], 0)
        tallies[4].add(k[wanted & (sizes <= ITEM_WORDS)], 1)

    def handed(kind: int) -> Iterator[pa.RecordBatch]:
        tally = tallies[kind]
        tally.merge()
        for i in range(0, len(tally.keys), 50_000):
            part = slice(i, i + 50_000)
            words = [spelled[k] for k in tally.keys[part].tolist()] if kind == 1 else [None] * len(tally.keys[part])
            columns = [pa.array(c[part]) for c in tally.counts]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), kind, np.int32)), pa.array(tally.keys[part].view(np.int64)), pa.array(words, pa.string()), *columns], names=["kind", "key", "word", "n", "ends", "stops"])
        tallies[kind] = _Tally()

    for batch in batches:
        texts = batch.column(0).to_pylist()
        for i in range(0, len(texts), 256):
            count(texts[i : i + 256])
            if len(spelled) > HELD_WORDS:
                yield from handed(1)
                spelled.clear()
    for kind in (1, 2, 3, 4):
        yield from handed(kind)


def truncated(df: DataFrame, key_: str, source: str, text: str) -> DataFrame:
    """(key, source, n_chars, marked, at_limit, last_token, mid_word, truncated) of every text.

    All texts are counted: how often each word occurs, and how often each run of up to three tokens
    ends a sentence or line. Words that occur KNOWN times inside texts make a trie, kept as a table of
    all their prefixes with the occurrences below each.

    A text is cut where its last word is unknown and a proper prefix of known ones (mid_word), unknown being less
    than KNOWN occurrences, or than KNOWN_SHARE of those of the words that go on from it; or
    where the run it stops with rarely ends anything: by three tokens, by fewer where those are unknown.
    The bar is higher where the source left a mark (an ellipsis, a replacement character) or the text
    has exactly the greatest length of its source, shared by LIMIT_SHARE of its texts; short
    lines of lists are cut only behind words that end nothing. Ends of texts are left out of these counts. But a run where far more texts end than cuts would
    leave there by chance is how whole texts end, even if it occurs nowhere else ("END OF REPORT").

    Null and empty texts, and texts of white space or marks alone, are not cut. A key that repeats
    counts once; null keys are left out; null sources form one source. Texts are read whole. Other
    columns, whatever their names, are ignored.

    Exact copies are one piece of evidence: all that is counted, greatest lengths included, is counted
    over distinct texts (by a hash of 128 bits), and each copy gets the verdict of its text.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key_}`").alias("_key"), F.col(f"`{source}`").alias("_source"), F.col(f"`{text}`").alias("_text")).where("_key IS NOT NULL").withColumn("_hash", F.unhex(F.md5("_text")))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("_key", "_source")}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = [ending(t) if t else None for t in texts]
            columns = [
                pa.array([len(t) if t else 0 for t in texts], pa.int64()),
                *(pa.array([f[i] if f else None for f in found], kind) for i, kind in enumerate((pa.bool_(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.int64()))),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *columns], names=["_key", "_source", "_hash", "n_chars", "marked", "last_token", "in_line", "keys", "alt"])

    tails = cut(rows.mapInArrow(read, f"_key {kinds['_key']}, _source {kinds['_source']}, _hash BINARY, n_chars BIGINT, marked BOOLEAN, last_token STRING, in_line INT, keys ARRAY<BIGINT>, alt BIGINT").dropDuplicates(["_key"]))
    once = cut(tails.dropDuplicates(["_hash"]))
    size = once.agg(F.count("*").alias("texts"), F.sum("n_chars").alias("chars")).first()
    by_chance = CUT_SHARE * size["texts"] / max(size["chars"] or 0, 1)

    # A filter tells which runs stand at any text's end; it has room for all there are.
    ends = cut(once.select(F.explode(F.concat("keys", F.when(F.col("alt").isNotNull(), F.array("alt")).otherwise(F.array().cast("array<bigint>")))).alias("k")).distinct())
    room = min(max((ends.count() * BITS_A_RUN - 1).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    low = F.col("k").bitwiseAND(F.lit((1 << room) - 1))
    words = ends.select(F.shiftright(low, 6).alias("w"), F.expr("shiftleft(1L, cast(k & 63 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    bits = np.zeros(1 << (room - 6), np.uint64)
    set_ = words.toArrow()  # no more rows than the filter has words, 4 million at most
    bits[set_["w"].to_numpy()] = set_["b"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bits)
    counted = without_repeats(rows.where("_text <> ''").select("_hash", "_text"), "_hash").select("_text").mapInArrow(lambda batches: _counted(batches, shared.value), "kind INT, key BIGINT, word STRING, n BIGINT, ends BIGINT, stops BIGINT")
    counts = cut(counted.groupBy("kind", "key").agg(F.max("word").alias("word"), F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.sum("stops").alias("stops")))

    # Each run at a text's end: occurrences inside texts, how many of those end something, and texts that end there.
    asked = tails.select("_key", F.posexplode("keys").alias("order", "k")).select("_key", (F.col("order") + 1).alias("kind"), F.col("k").alias("key"))
    final = once.select(F.posexplode("keys").alias("order", "key")).groupBy((F.col("order") + 1).alias("kind"), "key").agg(F.count("*").alias("f"))
    stops = once.where("alt IS NOT NULL").select(F.lit(3).alias("kind"), F.col("alt").alias("key")).distinct().withColumn("f", F.lit(0).cast("long"))
    runs = final.unionByName(stops.join(final.select("kind", "key"), ["kind", "key"], "left_anti")).join(counts.drop("word"), ["kind", "key"], "left")
    runs = runs.select("kind", "key", "f", (F.coalesce("n", F.lit(0)) - F.col("f")).alias("i"), (F.coalesce("ends", F.lit(0)) - F.col("f")).alias("e"), F.coalesce("stops", F.lit(0)).alias("s"))
    alts = tails.where("alt IS NOT NULL").select("_key", F.lit(5).alias("kind"), F.col("alt").alias("key"))
    found = asked.unionByName(alts).join(runs.toDF("_kind", "_run", "f", "i", "e", "s"), (F.col("key") == F.col("_run")) & (F.when(F.col("kind") == 5, 3).otherwise(F.col("kind")) == F.col("_kind")))
    pick = lambda order, c: F.coalesce(F.max(F.when(F.col("kind") == order, F.col(c))), F.lit(0))
    seen = found.groupBy("_key").agg(*(pick(o, c).alias(f"{c}{o}") for o in range(1, 6) for c in ("f", "i", "e", "s")))

    # The trie: every proper prefix of a known word is a node, with the occurrences of the words below it.
    inside = counts.where("kind = 1").join(final.where("kind = 1").select("key", "f"), "key", "left").select("word", (F.col("n") - F.coalesce("f", F.lit(0))).alias("i"))
    known = inside.where((F.col("i") >= KNOWN) & F.col("word").rlike(r"^\p{L}{2,}$"))
    nodes = known.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), n -> left(word, n))")).alias("prefix"), "i").groupBy("prefix").agg(F.sum("i").alias("below"))

    lengths = tails.select("_source", "_hash", "n_chars").distinct().groupBy("_source", "n_chars").count()
    limits = lengths.groupBy("_source").agg(F.max(F.struct("n_chars", "count")).alias("m"), F.sum("count").alias("all")).where(F.col("m.count") >= F.greatest(F.lit(2), F.ceil(F.col("all") * LIMIT_SHARE)))
    limits = limits.select(F.col("_source").alias("_limited"), F.col("m.n_chars").alias("limit"))

    all_ = (
        tails.drop("keys", "_hash")
        .join(seen, "_key", "left")
        .join(nodes, F.col("last_token") == F.col("prefix"), "left")
        .join(limits, F.col("_source").eqNullSafe(F.col("_limited")), "left")
        .withColumn("at_limit", F.coalesce(F.col("n_chars") == F.col("limit"), F.lit(False)))
        .withColumn("suspect", F.coalesce("marked", F.lit(False)) | F.col("at_limit"))
        .withColumn("item", (F.col("in_line") <= ITEM_WORDS) & (F.col("i4") + F.col("f4") > KNOWN) & (F.col("e4") + F.col("f4") >= ITEM_SHARE * (F.col("i4") + F.col("f4"))))
    )
    below = F.coalesce("below", F.lit(0))
    goes_on = {k: F.col(f"i{k}") - F.col(f"e{k}") for k in (1, 2, 3)}
    often = {k: F.col(f"f{k}") >= max(4.0, USUAL_SHARE * size["texts"]) for k in (1, 2, 3)}
    usual = {k: (F.col(f"f{k}") > 1) & (F.col(f"f{k}") >= SURELY * by_chance * (goes_on[k] + below)) & ((goes_on[k] + below == 0) | often[k]) for k in (1, 2, 3)}
    bar = F.when(F.col("suspect"), SUSPECT_ENDS).otherwise(RARELY_ENDS)
    lost = F.when(F.col("i1") >= KNOWN, (F.col("e1") < bar * F.col("i1")) & ~usual[1]).when(usual[1], F.lit(False)).otherwise(F.col("suspect"))
    for k in (2, 3):
        lost = F.when(F.col(f"i{k}") >= KNOWN, (F.col(f"e{k}") < bar * F.col(f"i{k}")) & ~usual[k]).when(usual[k], F.lit(False)).otherwise(lost)
    # An item may end with any word that ends sentences; it is cut behind a word like "the".
    lost = F.when(F.col("item"), (F.col("i1") >= KNOWN) & (F.col("e1") + F.col("s1") < ITEM_ENDS * F.col("i1")) & ~usual[2] & ~usual[3]).otherwise(lost)
    mid_word = (below > 0) & (F.col("i1") < F.greatest(F.lit(KNOWN), KNOWN_SHARE * below)) & ~(usual[2] & often[2]) & ~(usual[3] & often[3])
    stop = F.col("i3") + F.col("i5")
    by_stop = F.col("alt").isNotNull() & (stop >= KNOWN) & (F.col("i3") < bar * stop)
    lost = F.when(F.col("last_token").endswith("\x1e"), by_stop).otherwise(mid_word | lost)
    return all_.select(F.col("_key").alias(key_), F.col("_source").alias(source), "n_chars", F.coalesce("marked", F.lit(False)).alias("marked"), "at_limit", F.translate("last_token", "\x1e", "").alias("last_token"), F.coalesce(mid_word, F.lit(False)).alias("mid_word"), F.coalesce(lost, F.lit(False)).alias("truncated"))


def rates(found: DataFrame, source: str) -> DataFrame:
    """(source, texts, truncated, rate, mid_word, at_limit) of each source; texts counts null and empty ones too,
    mid_word the truncated ones whose last word told it."""
    return found.groupBy(source).agg(F.count("*").alias("texts"), F.count_if("truncated").alias("truncated"), F.avg(F.col("truncated").cast("double")).alias("rate"), F.count_if(F.col("mid_word") & F.col("truncated")).alias("mid_word"), F.count_if("at_limit").alias("at_limit"))
