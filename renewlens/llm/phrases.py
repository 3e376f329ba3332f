"""Phrase collocations by vertical partitioning of the suffixes of all texts.

Every word position starts a suffix of at most five words. Word prefixes are
counted level by level: words, then pairs of frequent words, then, only below
prefixes with more suffixes than fit the memory budget, triples and quadruples. The
prefixes of the last level needed are dealt to groups, and each group builds its
depth-truncated suffix subtree on its own: its suffixes are sorted by Spark
and read as a stream, whose runs are the nodes; the count of a node is the total of its leaves.

Words travel as 64-bit hashes of (language, word). That no two words of one hash
are frequent, alone or together, is checked over the whole vocabulary; else another salt is taken.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, table, text_chunks

LEAST, LONGEST, TOP = 100, 5, 2_000
UNKNOWN = "und"
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
#: Breaks become full stops, tabs blanks; a full stop can be no part of a word.
CLEAN = bytes(0x2E if c in BREAKS else 0x20 if c == 9 else c for c in range(256))
#: Word positions that a task combines at a time, and distinct words that it counts before handing them on.
POSITIONS, WORDS_AT_ONCE = 1 << 22, 200_000
#: Suffixes of one prefix that a group may hold; it grows with the corpus so that no more than MOST_HEAVY prefixes exceed it.
BUDGET, MOST_HEAVY = 1 << 20, 1_000_000
#: Largest bitmap that tells tasks which words and pairs are frequent; a fuller one only lets more through.
MOST_BITS = 1 << 28
SEED, SALTS = 42, 50
H = ["h1", "h2", "h3", "h4", "h5"]
TURNS = (0, 23, 46, 5, 28)


def split_words(text: bytes) -> list[bytes]:
    """The lower-cased words of a text, with ``.`` for every break between pieces."""
    return text.lower().translate(CLEAN).replace(b".", b" . ").split()  # bytes: only A-Z are lowered


def segments(text: bytes, size: int = 8_000_000) -> Iterator[bytes]:
    """A very long text in parts that end at breaks, so that only some of its words are held at a time."""
    while len(text) > size:
        at = min((i for i in (text.find(b, size) for b in (b".", b"\n", b",")) if i >= 0), default=len(text))
        yield text[: at + 1]
        text = text[at + 1 :]
    yield text


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def lang_prefix(lang: str, salt: int) -> bytes:
    return b"%d:%d:" % (salt, _signed(xxhash.xxh64_intdigest(lang.encode(), SEED)))


def word_hash(salt: int) -> Column:
    """The hash of (lang, word) as tasks make it."""
    return F.xxhash64(F.concat(F.lit(f"{salt}:"), F.xxhash64("lang").cast("string"), F.lit(":"), F.col("word")))


def vocabulary(picked: DataFrame) -> DataFrame:
    """(lang, word, n) of all words; tasks count before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for lang, words in found.items():
                columns = [pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])
            found.clear()

        for batch, texts in text_chunks(batches):
            for lang, text in zip(batch.column(0).to_pylist(), texts):
                words = found.setdefault(lang, Counter())
                for part in segments(text):
                    words.update(split_words(part))
                words.pop(b".", None)
                if sum(map(len, found.values())) > WORDS_AT_ONCE:
                    yield from hand_on()
        yield from hand_on()

    found = picked.mapInArrow(run, "lang string, word binary, n long")
    return found.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))


def with_hashes(words: DataFrame, least: int) -> tuple[DataFrame, int]:
    """``words`` with ``h`` and a salt by which words with one hash are together not frequent, and none is 0."""
    for salt in range(SALTS):
        hashed = words.withColumn("h", word_hash(salt))
        shared = hashed.groupBy("h").agg(F.count("*").alias("words"), F.sum("n").alias("n"))
        if shared.filter(f"n >= {least} AND (words > 1 OR h = 0)").isEmpty():
            return hashed, salt
    raise RuntimeError("no salt keeps the hashes of frequent words apart")


def mixed(parts: list) -> object:
    """One number for a prefix of hashes, in numpy; ``mixed_column`` is the same in Spark."""
    out = np.zeros(len(parts[0]), dtype=np.uint64)
    for h, turn in zip(parts, TURNS):
        out ^= h << np.uint64(turn) | h >> np.uint64(64 - turn) if turn else h
    return out


def mixed_column(names: list[str]) -> Column:
    turned = [f"(shiftleft({c}, {t}) | shiftrightunsigned({c}, {64 - t}))" if t else c for c, t in zip(names, TURNS)]
    return F.expr(" ^ ".join(turned))


class Bitmap:
    """Which numbers may be among the frequent ones: never wrong about those that are."""

    def __init__(self, keys: DataFrame, key: Column, n: int) -> None:
        self.bits = 1 << max(10, min(MOST_BITS.bit_length() - 1, (16 * n).bit_length()))
        slots = keys.select((key.bitwiseAND(F.lit(self.bits - 1))).alias("bit")).groupBy(F.expr("bit div 64").alias("slot"))
        marks = slots.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("mark")).toArrow()  # at most bits / 64 rows
        self.words = np.zeros(self.bits // 64, dtype=np.uint64)
        self.words[marks["slot"].to_numpy()] = marks["mark"].to_numpy().view(np.uint64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        low = keys & np.uint64(self.bits - 1)
        return (self.words[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


class Positions:
    """Word positions of some texts as small numbers, and the hashes of the words."""

    def __init__(self, salt: int) -> None:
        self.salt = salt
        self.clear()

    def clear(self) -> None:
        self.by_lang: dict[str, dict[bytes, int]] = {}
        self.next, self.parts, self.size = count(1).__next__, [], 0

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self.by_lang:
            self.by_lang[lang] = _Numbers(self.next)
        numbers = self.by_lang[lang]
        found = split_words(text)
        self.parts.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
        self.parts.append(np.zeros(1, np.int64))
        self.size += len(found) + 1

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hash by number); 0 is a break. Starts anew."""
        hashes = np.zeros(sum(map(len, self.by_lang.values())) + 1, dtype=np.uint64)
        for lang, numbers in self.by_lang.items():
            before, digest = lang_prefix(lang, self.salt), xxhash.xxh64_intdigest
            for word, i in numbers.items():
                if i:
                    hashes[i] = digest(before + word, SEED)
        ids = np.concatenate([*self.parts, np.zeros(LONGEST, np.int64)])  # no suffix runs over the end
        self.clear()
        return ids, hashes


class _Numbers(dict):
    """Numbers words as they come; the break is 0."""

    def __init__(self, following: Callable[[], int]) -> None:
        super().__init__({b".": 0})
        self.following = following

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.following()
        return n


def _combined(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of numbers, sorted, and how often each is there."""
    keys = [columns[i] << 32 | columns[i + 1] if i + 1 < len(columns) else columns[i] for i in range(0, len(columns), 2)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return [c[order[at]] for c in columns], np.diff(np.append(at, len(order)))


def _passed(picked: DataFrame, salt: int, rows: Callable[[np.ndarray, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One pass over all texts: ``rows`` of POSITIONS word positions at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions = Positions(salt)
        for batch, texts in text_chunks(batches):
            for lang, text in zip(batch.column(0).to_pylist(), texts):
                for part in segments(text):
                    positions.add(lang, part)
                    if positions.size >= POSITIONS:
                        yield rows(*positions.taken())
        yield rows(*positions.taken())

    return picked.mapInArrow(run, schema)


def _arrays(columns: list[np.ndarray], n: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), pa.array(n.astype(np.int64))], [*names, "n"])


def pair_counts(picked: DataFrame, salt: int, words: Bitmap) -> DataFrame:
    """(h1, h2, n) of neighbouring words that both may be frequent."""

    def rows(ids: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        good = words.holds(hashes)
        good[0] = False
        good = good[ids]
        at = np.flatnonzero(good[:-1] & good[1:])
        found, n = _combined([ids[at], ids[at + 1]])
        return _arrays([hashes[c] for c in found], n, H[:2])

    return _passed(picked, salt, rows, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))


class Suffixes:
    """Suffixes of three to five words of which each neighbouring pair may be frequent."""

    def __init__(self, words: Bitmap, pairs: Bitmap, heavy: list[np.ndarray]) -> None:
        self.words, self.pairs, self.heavy = words, pairs, heavy

    def of(self, ids: np.ndarray, hashes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Distinct suffixes (five columns of hashes, 0 behind the end) and how often each is there."""
        good = self.words.holds(hashes)
        good[0] = False
        good = good[ids]
        linked = good[:-1] & good[1:]
        at = np.flatnonzero(linked)
        linked[at] = self.pairs.holds(mixed([hashes[ids[at]], hashes[ids[at + 1]]]))
        starts = np.flatnonzero(linked[:-1] & linked[1:])
        columns, on = [ids[starts], ids[starts + 1], ids[starts + 2]], np.ones(len(starts), dtype=bool)
        for k in (3, 4):
            on = on & linked[np.minimum(starts + k - 1, len(linked) - 1)]
            columns.append(np.where(on, ids[np.minimum(starts + k, len(ids) - 1)], 0))
        found, n = _combined(columns)
        return [hashes[c] for c in found], n

    def depth(self, columns: list[np.ndarray]) -> np.ndarray:
        """How many words of a suffix name its group: two, and one more below every prefix over the budget."""
        out = np.full(len(columns[0]), 2)
        for level, keys in enumerate(self.heavy, 2):
            out[(out == level) & np.isin(mixed(columns[:level]), keys)] += 1
        return out


def level_counts(picked: DataFrame, salt: int, suffixes: Suffixes, level: int) -> DataFrame:
    """(h1 … h5, n) of the prefixes of ``level`` words below prefixes over the budget."""

    def rows(ids: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        columns, n = suffixes.of(ids, hashes)
        at = np.flatnonzero((suffixes.depth(columns) >= level) & (columns[level - 1] != 0))
        cut = [c[at] if k < level else np.zeros(len(at), np.uint64) for k, c in enumerate(columns)]
        return _arrays(cut, n[at], H)

    return _passed(picked, salt, rows, ", ".join(f"{h} long" for h in H) + ", n long").groupBy(*H).agg(F.sum("n").alias("n"))


def subtree_counts(picked: DataFrame, salt: int, suffixes: Suffixes, groups: int, least: int) -> DataFrame:
    """(h1 … h5, n) of all nodes of three to five words, from the subtrees of the groups."""
    longs = ", ".join(f"{h} long" for h in H) + ", n long"

    def rows(ids: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        columns, n = suffixes.of(ids, hashes)
        depth = suffixes.depth(columns)
        prefix = [np.where(depth > k, c, np.uint64(0)) for k, c in enumerate(columns)]
        out = _arrays(columns, n, H)
        return out.append_column("depth", pa.array(depth.astype(np.int32))).append_column("prefix", pa.array(mixed(prefix).view(np.int64)))

    leaves = _passed(picked, salt, rows, f"{longs}, depth int, prefix long")
    sorted_leaves = leaves.repartition(groups, "prefix").sortWithinPartitions(*H).drop("prefix")

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal first words are nodes. Those at both ends of a batch may go on beyond it and are handed on as they are."""
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(5)]
            n, depth = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            new = np.zeros(batch.num_rows, dtype=bool)
            new[0] = True
            for k, column in enumerate(columns):
                new[1:] |= column[1:] != column[:-1]
                if k < 2:
                    continue
                at = np.flatnonzero(new)
                total = np.add.reduceat(n, at)
                keep = total >= least
                keep[[0, -1]] = True
                keep &= (column[at] != 0) & (depth[at] <= k + 1)
                at = at[keep]
                yield _arrays([c[at] if i <= k else np.zeros(len(at), np.int64) for i, c in enumerate(columns)], total[keep], H)

    found = sorted_leaves.mapInArrow(nodes, longs)
    return found.groupBy(*H).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _key() -> Column:
    """The hashes of a phrase as an array without the empty places."""
    return F.filter(F.array(*H), lambda h: h != 0)


def phrase_counts(picked: DataFrame, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((lang, word, n, h) of frequent words, (key, a) of frequent phrases of two to five words, (lang, n) of all words)."""
    words, salt = with_hashes(stored(vocabulary(picked), "phrase-words"), least)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = stored(words.filter(F.col("n") >= least), "frequent-words")
    word_bits = Bitmap(frequent, F.col("h"), frequent.count())
    pairs = stored(pair_counts(picked, salt, word_bits).filter(F.col("n") >= least), "frequent-pairs")
    number, total = pairs.agg(F.count("*"), F.sum("n")).first()
    budget = max(budget, (total or 0) // MOST_HEAVY)
    pair_bits = Bitmap(pairs, mixed_column(H[:2]), number)

    def over(counts: DataFrame, level: int) -> np.ndarray:
        keys = counts.filter(F.col("n") > budget).select(mixed_column(H[:level]).alias("key")).distinct().toArrow()  # at most MOST_HEAVY
        return np.sort(keys["key"].to_numpy().view(np.uint64))

    heavy = [over(pairs, 2)]
    above = []  # nodes over their groups: no subtree holds all their leaves
    for level in (3, 4):
        if not len(heavy[-1]):
            break
        counted = stored(level_counts(picked, salt, Suffixes(word_bits, pair_bits, heavy), level), f"prefixes-{level}")
        heavy.append(over(counted, level))
        keys = counted.sparkSession.createDataFrame([(int(k),) for k in heavy[-1].view(np.int64)], "key long")
        above.append(counted.filter(F.col("n") >= least).join(keys, mixed_column(H[:level]) == F.col("key"), "left_semi"))
    groups = max(int(picked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // budget))
    found = subtree_counts(picked, salt, Suffixes(word_bits, pair_bits, heavy), groups, least)
    for more in above:
        found = found.unionByName(more)
    two = pairs.select("h1", "h2", *[F.lit(0).cast("long").alias(h) for h in H[2:]], "n")
    phrases = found.unionByName(two).select(_key().alias("key"), F.col("n").alias("a"))
    return frequent, stored(phrases, "phrases"), stored(sizes, "phrase-sizes")


def score(a: str, n: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)) in whole numbers of up to 38 digits."""
    d = lambda c, p: f"cast({c} AS decimal({p}, 0))"
    return F.expr(f"({d(a, 18)} * {d(f'{n} * 1000', 19)}) div ({d(l, 18)} * {d(r, 18)})")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, budget: int = BUDGET
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to five words of every language.

    Texts have A-Z lowered and are split into pieces at ``. , ; : ! ?`` and line ends, pieces into words at blanks and tabs. A candidate occurs
    ``a >= least`` times within pieces. Its score is the lowest of its cuts in two parts that occur ``l`` and ``r`` times:
    floor(1000 a n / (l r)), n being the words of the language; equal scores go to the shortest first part. Candidates
    that occur inside a longer one as often as at all are left out. Ranked by score, then a, then the phrase's bytes. NULL
    languages are ``und``. NULL and empty texts have no words, repeated rows count as often as they are there, very long texts are read
    whole. An empty table gives an empty table. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    picked = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"))
    words, phrases, sizes = phrase_counts(picked, least, budget)
    known = phrases.unionByName(words.select(F.array("h").alias("key"), F.col("n").alias("a")))
    longer = phrases.filter(F.size("key") > 2)
    inside = [longer.select(F.slice("key", start, F.size("key") - 1).alias("key"), "a") for start in (1, 2)]
    # a phrase as frequent as one around it is as frequent as one that is a single word longer
    open_ones = phrases.join(inside[0].unionByName(inside[1]), ["key", "a"], "left_anti")
    cuts = open_ones.select(
        "key", "a", F.explode(F.sequence(F.lit(1), F.size("key") - 1)).alias("k")
    ).select(
        "key", "a", "k", F.slice("key", F.lit(1), F.col("k")).alias("first"), F.slice("key", F.col("k") + 1, F.size("key") - F.col("k")).alias("rest")
    )
    cuts = cuts.join(known.select(F.col("key").alias("first"), F.col("a").alias("l")), "first")
    cuts = cuts.join(known.select(F.col("key").alias("rest"), F.col("a").alias("r")), "rest")
    of_lang = words.select(F.col("h").alias("h1"), "lang").join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, "lang")
    scored = cuts.withColumn("h1", F.col("key")[0]).join(of_lang, "h1")
    lowest = scored.groupBy("key", "a", "lang", "n").agg(F.min(F.struct(score("a", "n", "l", "r").alias("score"), "k", "l", "r")).alias("cut"))
    ranked = lowest.select("key", "lang", "a", "cut.l", "cut.r", "n", "cut.score").withColumn(
        "place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    )
    best = stored(ranked.filter(F.col("place") <= top).drop("place"), "best-phrases")
    spelled = (
        best.select("key", F.posexplode("key").alias("at", "h")).join(words.select("h", "word"), "h")
        .groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("parts"))  # at most five
        .select("key", F.array_join("parts.word", " ").alias("phrase"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        best.join(spelled, "key").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH piece AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w
  FROM documents
), sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY lang),
spot AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM piece),
gram AS (
  SELECT lang, w[i:i + k - 1] AS g, count(*) AS f FROM spot, (SELECT unnest(range(1, {LONGEST + 1})) AS k)
  WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= {LEAST}
), candidate AS (SELECT lang, g, f AS a FROM gram WHERE len(g) > 1),
inside AS (
  SELECT lang, sub, max(a) AS a FROM (
    SELECT lang, a, g[i:i + k - 1] AS sub FROM candidate, (SELECT unnest(range(1, {LONGEST + 1})) AS i), (SELECT unnest(range(2, {LONGEST})) AS k)
    WHERE i + k - 1 <= len(g) AND k < len(g)) GROUP BY lang, sub
), kept AS (
  SELECT candidate.lang, g, candidate.a FROM candidate LEFT JOIN inside ON inside.lang = candidate.lang AND sub = g
  WHERE inside.a IS NULL OR 100 * inside.a < 100 * candidate.a
), cut AS (
  SELECT kept.lang, kept.g, a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM kept JOIN sizes ON sizes.lang = kept.lang JOIN (SELECT unnest(range(1, {LONGEST})) AS k) ON k < len(kept.g)
  JOIN gram x ON x.lang = kept.lang AND x.g = kept.g[1:k] JOIN gram y ON y.lang = kept.lang AND y.g = kept.g[k + 1:len(kept.g)]
), lowest AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM cut
  QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM lowest
QUALIFY rank <= {TOP}"""
