"""Collocations: phrases of two to four words whose words keep together, by set-oriented (SETM) mining.

1. The occurrence relation: an entry for every word of a piece of text, sorted by (piece, position). It is written once, in blocks of
   some megabytes of text: a block is one row that holds its part of the relation column by column, in order: the word, and
   whether it stands at the position after the entry before it, in the same piece.
2. Group and count: words per language. The frequent ones are F1.
3. For each length k: the relation of length k-1, semi-joined with F(k-1), is merge-joined with itself at adjacent positions of a
   piece, which is a comparison of neighbours as both sides are sorted alike. The phrases are grouped and counted in each block,
   then over all blocks: Fk. The relation is semi-joined with Fk and written, in the same order, for the next length.
4. The semi-join is by a Bloom filter of Fk (`bloom`), of bounded size and the only thing that is broadcast. What it lets
   through by chance costs time and no more: Fk+1 is what is counted often enough, and a phrase that is not frequent has no frequent extension.
   Whole counts so stay exact whatever the filter does.
5. Frequent phrases, few against the text, are scored, thinned and ranked with joins of the F tables.

Words travel as 64-bit codes of (language, word). Whether two words share a code is looked up over all words; if so, all is coded
anew with another seed. Defined cases: a null text is empty, a null language is `und`; rows are not told apart by any id, so repeated rows
count again; no words give no rows; columns other than the two named are left aside.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelwarrant.llm import bloom
from pixelwarrant.llm.shared import stored
from pixelwarrant.llm.words import chunks, kinds, words

#: Words are split at spaces and tabs, pieces at these.
CUTS = kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
LONGEST = 4
UNKNOWN = "und"

#: A block of the relation: of each entry a byte of flags and the place of its word (32 bits) in `codes` (64 bits each).
RELATION = "flags binary, word binary, codes binary"
MARKED, FOLLOWS = 1, 2  # a phrase of the present length starts here; this is the position after the entry before
#: A block, or a word of one.
BLOCKS = RELATION + ", code long, lang string, token string, n long"


def code(lang: bytes, word: bytes, seed: int) -> bytes:
    from xxhash import xxh64_digest

    return xxh64_digest(b"%d:%b%b" % (len(lang), lang, word), seed)


def occurrences(docs: DataFrame, lang: str, text: str, seed: int) -> DataFrame:
    """The relation in blocks, and after each block a row for each of its words: code, language, word and count."""

    def block(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = words(part.column(1), CUTS, lower=True)
        if not len(found.codes):
            return
        tongues = pc.fill_null(part.column(0).cast(pa.string()), UNKNOWN).dictionary_encode()
        # Local words, by language and word.
        both = tongues.indices.to_numpy(zero_copy_only=False).astype(np.int64)[found.doc] * len(found.distinct) + found.codes
        own, place, counts = np.unique(both, return_inverse=True, return_counts=True)
        names = [x.encode() for x in tongues.dictionary.to_pylist()]
        spoken = own // len(found.distinct)
        written = found.distinct.take(pa.array(own % len(found.distinct)))
        raw = b"".join([code(names[i], w, seed) for i, w in zip(spoken.tolist(), written.to_pylist())])
        flags = np.full(len(place), MARKED, np.uint8)
        flags[1:][found.piece[1:] == found.piece[:-1]] |= FOLLOWS
        rows = _block(flags, place, np.frombuffer(raw, np.int64))
        lists = [pa.array(np.frombuffer(raw, np.int64)), tongues.dictionary.take(pa.array(spoken)), written.cast(pa.binary()).cast(pa.string()), pa.array(counts.astype(np.int64))]
        none = [pa.nulls(1, x.type) for x in lists]
        yield pa.RecordBatch.from_arrays([*rows, *none], NAMES)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(own), pa.binary())] * 3, *lists], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                yield from block(part)

    return docs.select(lang, text).mapInArrow(run, BLOCKS)


NAMES = ["flags", "word", "codes", "code", "lang", "token", "n"]


def _block(flags: np.ndarray, word: np.ndarray, codes: np.ndarray) -> list[pa.Array]:
    return [pa.array([x.tobytes()], pa.binary()) for x in (flags, word.astype(np.int32), codes)]


# ---- one length after the other


def adjacent(flags: np.ndarray) -> np.ndarray:
    """The merge-join: entries of the relation that are followed, at the next position of the piece, by another one."""
    return np.flatnonzero((flags[:-1] & MARKED) & (flags[1:] & MARKED) & (flags[1:] // FOLLOWS))


def _each(relation: DataFrame, schema: str, work: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                flags, word, codes = (np.frombuffer(batch.column(i)[row].as_buffer(), kind) for i, kind in enumerate((np.uint8, np.int32, np.int64)))
                yield from work(flags, word, codes)

    return relation.select("flags", "word", "codes").mapInArrow(run, schema)


def names_of(length: int) -> list[str]:
    return [f"c{i + 1}" for i in range(length)]


def counted(relation: DataFrame, length: int) -> DataFrame:
    """c1, ..., and how often (`n`) the relation's rows, joined with their neighbours, give that phrase; one row for each block that has it."""
    names = names_of(length)

    def work(flags: np.ndarray, word: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = adjacent(flags)
        if not len(first):
            return
        # Phrases are told apart by the places of their words in the block, two names becoming one at a time.
        name, size = word[first].astype(np.int64), int(word.max()) + 1
        for i in range(1, length):
            _, index, name, n = np.unique(name * size + word[first + i], return_index=True, return_inverse=True, return_counts=True)
        at = first[index]
        yield pa.RecordBatch.from_arrays([pa.array(codes[word[at + i]]) for i in range(length)] + [pa.array(n.astype(np.int64))], [*names, "n"])

    return _each(relation, ", ".join(f"{c} long" for c in names) + ", n long", work)


def narrowed(relation: DataFrame, length: int, filter) -> DataFrame:
    """The relation of phrases of `length` words: the joined entries that pass the filter of frequent ones, marked at their first word."""

    def work(flags: np.ndarray, word: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = adjacent(flags) if length > 1 else np.arange(len(flags))
        first = first[bloom.passes(filter.value, [codes[word[first + i]] for i in range(length)])]
        marked = np.zeros(len(flags), np.uint8)
        marked[first] = MARKED
        held = marked.astype(bool)
        for i in range(1, length):
            held[first + i] = True
        kept = np.flatnonzero(held)
        if not len(kept):
            return
        # Words of no phrase go; what stood after one of them follows no entry any more.
        near = np.diff(kept, prepend=-2) == 1
        used, place = np.unique(word[kept], return_inverse=True)
        yield pa.RecordBatch.from_arrays(_block(marked[kept] | (flags[kept] & FOLLOWS & np.where(near, FOLLOWS, 0).astype(np.uint8)), place, codes[used]), NAMES[:3])

    return _each(relation, RELATION, work)


def frequent_phrases(blocks: DataFrame, frequent_words: DataFrame, least: int, longest: int) -> list[DataFrame]:
    """For each length from 2: c1, c2, ... and a, of the phrases that occur `least` times or more."""
    context = blocks.sparkSession.sparkContext
    relation = blocks.where("flags is not null")
    frequent, out = frequent_words.select(F.col("code").alias("c1")), []
    for length in range(1, longest):
        filter = context.broadcast(bloom.build(frequent, names_of(length)))
        relation = narrowed(relation, length, filter)
        if length > 1:
            relation = stored(relation)
        names = names_of(length + 1)
        frequent = stored(counted(relation, length + 1).groupBy(*names).agg(F.sum("n").alias("a")).where(F.col("a") >= least))
        out.append(frequent)
    return out


def exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 30, longest: int = LONGEST, cover: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's `top` collocations.

    A phrase of `a >= least` occurrences is cut once into two parts of l and r occurrences; its score is the least, over its cuts, of
    2000000 a / (l + r). It goes if a longer such phrase holds it and occurs `cover` hundredths as often, or more.
    """
    for seed in range(100):
        blocks = stored(occurrences(docs, lang, text, seed))
        lists = blocks.where("code is not null")
        vocabulary = stored(lists.groupBy("code", "lang", F.col("token").alias("word")).agg(F.sum("n").alias("f")))
        if vocabulary.groupBy("code").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("no seed gives every word a code of its own")
    single = vocabulary.where(F.col("f") >= least)
    tables = frequent_phrases(blocks, single, least, longest)
    longer = [t.select(F.array(*names_of(i + 2)).alias("p"), "a") for i, t in enumerate(tables)]
    phrases = stored(reduce(DataFrame.unionByName, longer, single.select(F.array("code").alias("p"), F.col("f").alias("a"))))
    candidates = phrases.where(F.size("p") > 1)

    cuts = candidates.select("p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("p", F.lit(1), F.col("k")).alias("left"), F.slice("p", F.col("k") + 1, F.size("p")).alias("right"))
    cuts = cuts.join(phrases.toDF("left", "l"), "left").join(phrases.toDF("right", "r"), "right")
    cuts = cuts.withColumn("score", F.expr("(2000000BD * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = cuts.groupBy("p", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    ends = F.explode(F.expr("flatten(transform(sequence(2, size(p) - 1), n -> transform(sequence(1, size(p) - n + 1), i -> slice(p, i, n))))"))
    holders = candidates.where(F.size("p") > 2).select(ends.alias("p"), F.col("a").alias("of")).groupBy("p").agg(F.max("of").alias("of"))
    kept = best.join(holders, "p", "left").where(F.col("of").isNull() | (exact("of") * 100 < exact("a") * cover)).select("p", "a", "cut")

    spelled = kept.select("p", "a", "cut", F.posexplode("p").alias("i", "code")).join(single.select("code", "lang", "word"), "code")
    spelled = spelled.groupBy("p", "a", "cut").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w"))
    spelled = spelled.select("lang", F.array_join(F.col("w.word"), " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    sizes = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = 30, cover: int = 80, top: int = 2000) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lengths = " UNION ALL ".join(
        f"SELECT lang, {k} AS size, concat_ws(' ', {', '.join(f'w{i}' for i in range(1, k + 1))}) AS phrase, count(*) AS a FROM runs WHERE w{k} IS NOT NULL GROUP BY ALL"
        for k in range(1, LONGEST + 1)
    )
    leads = ", ".join(f"lead(w, {i}) OVER (PARTITION BY id, piece ORDER BY pos) AS w{i + 1}" for i in range(LONGEST))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '{UNKNOWN}') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents),
pieces AS (SELECT id, lang, generate_subscripts(pieces, 1) AS piece, unnest(pieces) AS s FROM docs),
lists AS (SELECT id, lang, piece, list_filter(regexp_split_to_array(s, '[ \\t]+'), lambda x: x <> '') AS ws FROM pieces),
occurrences AS (SELECT id, lang, piece, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM lists),
runs AS (SELECT lang, {leads} FROM occurrences),
counts AS ({lengths}),
sizes AS (SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS ws FROM counts WHERE size > 1 AND a >= {least}),
cuts AS (SELECT c.lang, c.phrase, c.size, c.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
    JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:k], ' ') AND l.size = k
    JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k + 1:], ' ') AND r.size = c.size - k),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, a, array_to_string(ws[i:i + n - 1], ' ') AS phrase FROM
    (SELECT *, unnest(range(1, size - n + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS n FROM candidates WHERE size > 2))),
held AS (SELECT lang, phrase, max(a) AS a FROM inner_parts GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase
    WHERE h.a IS NULL OR 100::HUGEINT * h.a < {cover}::HUGEINT * b.a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM
    (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN sizes USING (lang) WHERE rank <= {top}
"""
