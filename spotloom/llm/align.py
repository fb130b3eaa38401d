"""Alignment of two tokenizers over the same texts.

One Arrow map encodes texts by both tokenizers.  Text between two single spaces is encoded once for a worker and looked
up from then on, which is exact: pieces of A begin at such a space, and no piece of B has a space mark behind
another character (checked when B is read).  For each block of texts the map gives the different stretches of the block,
each with token ids and the byte offsets at which tokens end, and the texts as numbers of stretches.

All else is DataFrame functions.  In each stretch the offsets in both lists (array_intersect) cut the tokens into groups.  Both
lists of ends, sorted together, say for every piece of text between two ends which token of A and which of B cover it:
that is one link for each distinct end, since two tokens overlap in one piece only.  A stretch ends both lists, so
groups and links of a text are those of its stretches, one after the other.

Links are kept as one number for each pair of ids, and the corpus-wide counts are one aggregation with map-side sums.  The
counts are written; where they are few (SENT rows at most, counted) they are sent to the tasks, beyond that each document's
distinct pairs are joined to them by shuffle, where the planner can split pairs that are in a third of all documents.

Defined results: null and empty texts, and those whose tokens don't spell a space and the text (a text with the
space mark itself), have no tokens, groups or links; texts may be of any length (one text is one row of arrays);
special tokens' strings are plain text; repeated rows give a row each and all count; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotloom.llm.common import Scratch, keep, ship, slices, table
from spotloom.llm.toxicity import ranges

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE_MARK = "▁"
#: a space between two characters that no tokenizer takes for white space
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: a space at an end or beside other white space
BESIDE = re.compile(r" (?:\s|$|(?<=\s )|(?<=^ ))")
#: chunks that are encoded in one call
JOINED = 2000
#: numbers of tokens of text kept by a worker from one part to the next
KEPT = 3_000_000
#: rows of pair counts that may be sent to every task: under 100 MB as a hash table
SENT = 4_000_000

#: tokens of a stretch that is worked on by look-ups; a longer one is walked through
SHORT = 128
#: bytes of text in a block
BLOCK = 3 << 20
STRETCH = ("a", "a_end", "b", "b_end")


class Pair:
    """Both tokenizers, and what they gave for stretches of text met before."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece

        self.first, self.spell_a = _byte_bpe(a)
        self.second = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.spell_b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.length = [np.array([len(t) for t in spell], np.int32) for spell in (self.spell_a, self.spell_b)]
        self.apart = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.ok = np.empty(0, bool)
        self.ids = [np.empty(0, np.int32), np.empty(0, np.int32)]
        self.at = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def both(self, text: str) -> list[np.ndarray]:
        """Ids of a space and the text by A and by B, which adds the space itself."""
        return [np.array(self.first(" " + text), np.int32), np.array(self.second.encode(text, num_threads=1), np.int32)]

    def spells(self, tokens: list[np.ndarray], want: bytes) -> bool:
        return all(want == b"".join([spell[i] for i in t.tolist()]) for spell, t in zip((self.spell_a, self.spell_b), tokens))

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks; those without white space at an end some thousands at a time, joined by spaces."""
        plain = [c for c in chunks if c and not c[0].isspace() and not c[-1].isspace()] if self.apart else []
        odd = set(chunks).difference(plain)
        got: list[list[np.ndarray]] = [[], []]
        counts: list[list[np.ndarray]] = [[], []]
        ok: list[np.ndarray] = []
        order: list[str] = []
        for i in range(0, len(plain), JOINED):
            part = plain[i : i + JOINED]
            text = " ".join(part)
            tokens = self.both(text)
            if not self.spells(tokens, b" " + text.encode()):
                odd.update(part)
                continue
            ends = np.cumsum(np.fromiter((len(c.encode()) + 1 for c in part), np.int64, len(part)))
            for k in (0, 1):
                upto = np.searchsorted(np.cumsum(self.length[k][tokens[k]]), ends, "right")
                got[k].append(tokens[k])
                counts[k].append(np.diff(upto, prepend=0))
            ok.append(np.ones(len(part), bool))
            order += part
        for c in odd:
            tokens = self.both(c)
            for k in (0, 1):
                got[k].append(tokens[k])
                counts[k].append(np.array([len(tokens[k])]))
            ok.append(np.array([self.spells(tokens, b" " + c.encode())]))
            order.append(c)
        self.ok = np.concatenate([self.ok, *ok])
        for k in (0, 1):
            self.ids[k] = np.concatenate([self.ids[k], *got[k]])
            self.at[k] = np.concatenate([self.at[k], self.at[k][-1] + np.cumsum(np.concatenate(counts[k]))])
        self.code.update(zip(order, range(len(self.code), len(self.code) + len(order))))

    def chunks(self, text: str) -> list[str]:
        if not self.apart:
            return [text]
        return BETWEEN.split(text) if BESIDE.search(text) else text.split(" ")

    def encode(self, texts: list[bytes | None]) -> tuple[list[pa.Array], list[pa.Array]]:
        """The block's stretches as lists of A's ids and ends and B's, and for each text its numbers of tokens and the places of its stretches."""
        if len(self.ids[0]) > KEPT:
            self.clear()
        cut = [self.chunks(t.decode("utf-8", "replace")) if t else [] for t in texts]
        new = set().union(*cut) - self.code.keys()
        if new:
            self.learn(list(new))
        count = np.array([len(c) for c in cut], np.int64)
        code = np.fromiter(map(self.code.__getitem__, chain.from_iterable(cut)), np.int64, int(count.sum()))
        row = np.repeat(np.arange(len(cut)), count)
        bad = np.bincount(row, ~self.ok[code], len(cut)) > 0
        code, row = code[~bad[row]], row[~bad[row]]
        used = np.zeros(len(self.ok), bool)
        used[code] = True
        place = np.cumsum(used) - 1
        own = np.flatnonzero(used)
        stretches, per_text = [], []
        for k in (0, 1):
            at, n = self.at[k][own], self.at[k][own + 1] - self.at[k][own]
            ids = self.ids[k][ranges(at, n)]
            offsets = np.concatenate([[0], np.cumsum(n)])
            ends = np.concatenate([[0], np.cumsum(self.length[k][ids], dtype=np.int64)])
            ends = ends[1:] - np.repeat(ends[offsets[:-1]], n)
            stretches += [_lists(offsets, ids), _lists(offsets, ends.astype(np.int32))]
            per_text.append(pa.array(np.bincount(row, (self.at[k][code + 1] - self.at[k][code]), len(cut)).astype(np.int32)))
        per_text.append(_lists(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(cut)))]), place[code].astype(np.int32)))
        return stretches, per_text


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _byte_bpe(data: bytes) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """A's encoder without special tokens, and the bytes of its tokens, from a byte-level BPE file of the tokenizers library.

    Where every merge makes the token of the next number, merges go by the number of the token made, as the tiktoken
    library does it, several times as fast; else the tokenizers library encodes.
    """
    import tiktoken
    from tokenizers import Tokenizer

    model, byte_of = json.loads(data)["model"], _byte_level()
    spell = {i: bytes(byte_of[c] for c in piece) for piece, i in model["vocab"].items() if all(c in byte_of for c in piece)}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    whole = [spell.get(i, b"") for i in range(max(model["vocab"].values()) + 1)]
    single = {t for t in spell.values() if len(t) == 1}
    if len(single) == 256 and made == list(range(made[0], made[0] + len(made))):
        ranks = {spell[i]: i for i in made} | {t: i for i, t in spell.items() if len(t) == 1}
        return tiktoken.Encoding("pair", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, whole
    own = Tokenizer.from_str(data.decode())
    own.encode_special_tokens = True
    return lambda text: own.encode(text, add_special_tokens=False).ids, whole


def _byte_level() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _read(name: str, path: str | None) -> bytes:
    with open(path or public_tokenizers.path(name), "rb") as f:
        return f.read()


def tokens(docs: DataFrame, keys: list[str], text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """A row for each block of texts: a, a_end, b, b_end (lists of the stretches' token ids and byte ends; the first byte is a
    space) and docs (keys, n_a, n_b, and the places of the text's stretches).

    Both vocabularies (megabytes) are read on the driver and sent along.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((_read(A, a_path), _read(B, b_path)))
    src = docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("binary").alias("__text"))
    ints = T.ArrayType(T.IntegerType())
    doc = T.StructType([*[src.schema[k] for k in keys], T.StructField("n_a", T.IntegerType()), T.StructField("n_b", T.IntegerType()), T.StructField("places", ints)])
    schema = T.StructType([*[T.StructField(f, T.ArrayType(ints)) for f in STRETCH], T.StructField("docs", T.ArrayType(doc))])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        inner = arrow.field("docs").type.value_type
        a, b = sent.value
        pair = keep(("align", hash(a), hash(b)), lambda: Pair(a, b))
        for batch in batches:
            for part in slices(batch, len(keys), BLOCK):
                stretches, per_text = pair.encode(part.column(len(keys)).to_pylist())
                columns = [c.cast(inner.field(i).type) for i, c in enumerate([*part.columns[:-1], *per_text])]
                block = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (*stretches, pa.StructArray.from_arrays(columns, fields=list(inner)))]
                yield pa.RecordBatch.from_arrays([c.cast(arrow.field(i).type) for i, c in enumerate(block)], schema=arrow)

    return src.mapInArrow(run, schema)


#: a place among ends: end, kind (0: A, 1: B) and number of the token in one long, so that sorting is by end, A first
_KIND = 1 << 31


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_KIND - 1).cast("long")).cast("int")


def _linker(b_ids: int, kind: str) -> Callable[[Column, Column], Column]:
    """A pair of ids as one number: A's id * b_ids + B's."""
    return lambda x, y: x.cast(kind) * F.lit(b_ids).cast(kind) + y.cast(kind)


def _ordered(t: Column) -> Column:
    """All ends of a stretch in order, each with its kind and place."""
    mark = lambda x, kind: F.transform(x, lambda e, i: F.shiftleft(e.cast("long"), 32) + (i + F.lit(kind).cast("long")))
    return F.sort_array(F.concat(mark(t["a_end"], 0), mark(t["b_end"], _KIND)))


def _covers(s: Column, ends: Column, _link: Callable, kind: str) -> Column:
    """For each end (link, null), or (null, place of A's token and of B's) where the end before is the same: a cut.

    Of the ends before the r-th, those of the other kind are r less its own place, which is the other token's place.
    """
    link = lambda i, j: F.struct(_link(F.get(s["a"], i), F.get(s["b"], j)).alias("link"), F.lit(None).cast("struct<i:int,j:int>").alias("cut"))

    def one(x: Column, r: Column) -> Column:
        is_a = x.bitwiseAND(F.lit(_KIND).cast("long")) == 0
        # B's end is never first where A has the same
        tie = F.shiftright(F.get(ends, F.greatest(r - 1, F.lit(0))), 32) == F.shiftright(x, 32)
        cut = F.struct(F.lit(None).cast(kind).alias("link"), F.struct((r - _low(x)).alias("i"), (_low(x) + 1).alias("j")).alias("cut"))
        return F.when(is_a, link(_low(x), r - _low(x))).when((r > 0) & tie, cut).otherwise(link(r - _low(x), _low(x)))

    return F.transform(ends, one)


def _before(cuts: Column, k: Column) -> Column:
    return F.coalesce(F.get(cuts, k - 1), F.lit(0))


def _part(tokens: Column, cuts: Column, end: Column, k: Column) -> Column:
    """The k-th group's tokens, of which the last is the end-th."""
    start = _before(cuts, k)
    return F.when(end - start == 1, F.get(tokens, start)).otherwise(F.array_join(F.slice(tokens, start + 1, end - start), ","))


def _written(t: Column) -> Column:
    """The text of a stretch's groups, that end with the i-th tokens of A and the j-th of B."""
    pair = lambda x, y: F.concat(x, F.lit("|"), y)
    of = lambda tokens, cuts: F.transform(cuts, lambda end, k: _part(tokens, cuts, end, k))
    single = (F.size(t["i"]) == F.size(t["a_text"])) & (F.size(t["i"]) == F.size(t["b_text"]))
    return F.array_join(F.when(single, F.zip_with(t["a_text"], t["b_text"], pair)).otherwise(F.zip_with(of(t["a_text"], t["i"]), of(t["b_text"], t["j"]), pair)), ";")


def _at(ends: Column, e: Column) -> Column:
    return F.array_position(ends, e).cast("int")


def _linked(t: Column, link: Callable[[Column, Column], Column]) -> Column:
    """Links of a stretch, ends looked up in its short lists.

    The place of an end in the sorted list of all ends, less its place in its own, is the number of the other's ends
    before it, and so the place of the other token that covers it.
    """
    of_a = F.zip_with(t["a"], t["a_end"], lambda x, e: link(x, F.get(t["b"], _at(t["ends"], e) - _at(t["a_end"], e))))
    of_b = F.transform(F.array_except(t["b_end"], t["shared"]), lambda e: link(F.get(t["a"], _at(t["ends"], e) - _at(t["b_end"], e)), F.get(t["b"], _at(t["b_end"], e) - 1)))
    single = (F.size(t["shared"]) == F.size(t["a"])) & (F.size(t["shared"]) == F.size(t["b"]))
    return F.when(single, F.zip_with(t["a"], t["b"], link)).otherwise(F.concat(of_a, of_b))


def _is_long(t: Column) -> Column:
    return F.size(t["a_end"]) + F.size(t["b_end"]) > SHORT


def _cuts(t: Column) -> Column:
    """(i, j) of a long stretch: the numbers of A's and B's tokens up to each end of a group."""
    return F.transform(F.filter(t["covers"], lambda x: x["cut"].isNotNull()), lambda x: x["cut"])


def aligned(blocks: DataFrame, keys: list[str], b_ids: int, kind: str = "long") -> DataFrame:
    """keys, n_a, n_b, n_groups, n_links, groups (text: `a1,a2|b1;a3|b2,b3`) and links (each A's id * b_ids + B's).

    What is found for a block's stretches is a column in each step, so that it is computed once.  A stretch of over SHORT tokens is
    walked through, in time in proportion to its length; blocks without such stretches have no column for that.
    """
    link = _linker(b_ids, kind)
    text = lambda c: F.col(c).cast("array<array<string>>").alias(f"{c}_text")

    def each(names: list[str], short: Callable[[Column], Column], long: Callable[[Column], Column] | None = None) -> Column:
        if long is None:
            return F.transform(F.arrays_zip(*names), short)
        mixed = F.transform(F.arrays_zip(*names, "covers"), lambda t: F.when(t["covers"].isNotNull(), long(t)).otherwise(short(t)))
        return F.when(F.col("covers").isNotNull(), mixed).otherwise(F.transform(F.arrays_zip(*names), short))

    own = each(["a_end", "b_end"], lambda t: F.array_intersect(t["a_end"], t["b_end"])).alias("shared")
    covers = F.when(F.exists(F.arrays_zip("a_end", "b_end"), _is_long), each(list(STRETCH), lambda t: F.when(_is_long(t), _let(_ordered(t), lambda e: _covers(t, e, link, kind)))))
    t = blocks.select("docs", *STRETCH, text("a"), text("b"), own, covers.alias("covers"))
    ends = each(["a_end", "b_end"], lambda t: F.sort_array(F.concat(t["a_end"], t["b_end"])))
    place = lambda end, f: each([end, "shared"], lambda t: F.transform(t["shared"], lambda e: _at(t[end], e)), lambda t: F.transform(_cuts(t), lambda c: c[f])).alias(f)
    t = t.select("*", ends.alias("ends"), place("a_end", "i"), place("b_end", "j"))
    links = each([*STRETCH, "shared", "ends"], lambda t: _linked(t, link), lambda t: F.transform(F.filter(t["covers"], lambda x: x["link"].isNotNull()), lambda x: x["link"]))
    t = t.select("docs", each(["a_text", "b_text", "i", "j"], _written).alias("groups"), links.alias("links"))

    def of_text(d: Column) -> Column:
        of = lambda f: F.transform(d["places"], lambda p: F.get(f, p))
        return F.struct(*[d[k].alias(k) for k in (*keys, "n_a", "n_b")], F.array_join(of("groups"), ";").alias("groups"), F.flatten(of("links")).alias("links"))

    t = t.select(F.explode(F.transform("docs", of_text)).alias("d")).select("d.*")
    # groups are parted by a mark that is in none of them; a group of m and n tokens has m + n - 1 links
    t = t.withColumn("n_groups", F.when(F.col("n_a") > 0, F.length("groups") - F.length(F.replace("groups", F.lit(";"), F.lit(""))) + 1).otherwise(0))
    counts = [F.col(c).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups")]
    return t.select(*[F.col(f"`{k}`") for k in keys], *counts, (F.col("n_a") + F.col("n_b") - F.col("n_groups")).cast("long").alias("n_links"), "groups", "links")


def link_counts(links: DataFrame, b_ids: int, scratch: Scratch) -> DataFrame:
    """(link, count, best): how often each pair of ids is linked, and whether no other A id is linked more often with its B id."""
    c = scratch.save(links.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("count")))
    top = c.groupBy((F.col("link") % b_ids).alias("y")).agg(F.max("count").alias("top"))
    # as many rows as B has ids, by the vocabulary's size
    return c.join(F.broadcast(top), F.col("link") % b_ids == F.col("y")).select("link", "count", (F.col("count") == F.col("top")).alias("best"))


def link_sums(links: DataFrame, counts: DataFrame, row: str, sent: int = SENT) -> DataFrame:
    """(row, n_best, count_sum) of each row with links."""
    each = links.select(row, F.explode("links").alias("link"))
    if counts.count() <= sent:
        j = each.join(F.broadcast(counts), "link").withColumn("n", F.lit(1))
    else:
        j = each.groupBy(row, "link").agg(F.count("*").alias("n")).join(counts, "link")
    return j.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("n") * F.col("count")).cast("long").alias("count_sum"))


def align(docs: DataFrame, keys: list[str], text: str = "text", a_path: str | None = None, b_path: str | None = None, sent: int = SENT, digest: bool = False) -> DataFrame:
    """keys, n_a, n_b, n_groups, n_links, n_best, count_sum, and groups as text or its SHA-256 ('' without tokens)."""
    import sentencepiece

    scratch = Scratch(docs.sparkSession)
    b_ids = sentencepiece.SentencePieceProcessor(model_proto=_read(B, b_path)).get_piece_size()
    a_ids = 1 + max(json.loads(_read(A, a_path))["model"]["vocab"].values())
    found = aligned(tokens(docs, keys, text, a_path, b_path), keys, b_ids, "int" if a_ids * b_ids < 1 << 31 else "long")
    if digest:
        found = found.withColumn("groups", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).withColumnRenamed("groups", "groups_sha256")
    # the number of a row is fixed by being written
    found = scratch.save(found.withColumn("__row", F.monotonically_increasing_id()))
    counts = scratch.save(link_counts(found, b_ids, scratch))
    sums = link_sums(found.select("__row", "links"), counts, "__row", sent)
    j = found.drop("links").join(sums, "__row", "left").drop("__row")
    return j.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), ["doc_id"], digest=True)


QUERIES = {"op12_align": op12_align}
SQL: dict[str, str] = {}
