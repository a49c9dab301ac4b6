"""Record keys, duplicates and validity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fuzzy as fz, text as tx, url as ul
from ..sources import store
from .selection import first_of_each

# A platform's part of a record's quality.
PLATFORM_QUALITY = {"semantic_scholar": 0.5, "arxiv": 0.45, "openalex": 0.4, "github": 0.35, "huggingface": 0.3, "wikipedia": 0.25, "web": 0.1}


# Forms of arXiv ids, in the order in which they are tried, with the group that is the id.
ARXIV_FORMS = ((r"arxiv\.org/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?", 1), (r"arxiv[./:]([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?", 1), (r"^([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?$", 1), (r"^(?:[a-z\-]+(?:\.[a-z\-]+)?/[0-9]{7})(?:v[0-9]+)?$", 0))
ARXIV_COLUMNS = ("arxiv_raw", "meta_id", "external_arxiv", "url")
QUALITY_PARTS = (("citation_count", 100.0, 3.0), ("stars", 1000.0, 2.0), ("downloads", 10_000.0, 1.0))


def arxiv_id(*raw: Column) -> Column:
    """The first arXiv id of the candidates, each tried in all forms."""
    found = lambda c, form, group: F.nullif(F.regexp_extract(F.lower(F.trim(F.coalesce(c, F.lit("")))), form, group), F.lit(""))
    return F.coalesce(*[found(c, form, group) for c in raw for form, group in ARXIV_FORMS])


def doi(raw: Column, external: Column | None = None, url: Column | None = None) -> Column:
    """The record's DOI, else the external one, else the url's; without its prefix, lower-cased; must begin with 10., and not be one that
    names an arXiv paper."""
    given = F.nullif(F.trim(F.coalesce(raw, F.lit(""))), F.lit(""))
    if external is not None:
        given = F.coalesce(given, F.nullif(F.trim(external), F.lit("")))
    if url is not None:
        given = F.coalesce(given, F.nullif(F.regexp_extract(F.lower(url), r"doi\.org/(10\.[^ \t\r\n]+)", 1), F.lit("")))
    bare = F.regexp_replace(F.lower(given), r"https?://doi\.org/|doi:|doi\.org/", "")
    return F.when(bare.startswith("10.") & ~bare.contains("arxiv"), bare)


def dedupe_key() -> Column:
    """By arXiv id, else DOI, else kind and title, else url where there is no title."""
    title = tx.normal_title(F.col("title"))
    kind = F.when(F.col("source_type") == "repository", "repo").otherwise(F.col("source_type"))
    return F.coalesce(
        F.concat(F.lit("arxiv:"), arxiv_id(*map(F.col, ARXIV_COLUMNS))), F.concat(F.lit("doi:"), doi(F.col("doi"), F.col("external_doi"), F.col("url"))),
        F.when(title == "", F.concat(F.lit("url:"), ul.without_tracking(F.col("url")))), F.concat(kind, F.lit(":"), title),
    )


def quality() -> Column:
    bonus = F.lit(0.0)
    for name, value in PLATFORM_QUALITY.items():
        bonus = F.when(F.col("platform") == name, value).otherwise(bonus)
    total = F.least(F.length(F.coalesce("abstract", F.lit(""))) / 1000, F.lit(2.0))
    for column, unit, most in QUALITY_PARTS:
        total = total + F.coalesce(F.least(F.col(column) / unit, F.lit(most)), F.lit(0.0))
    total = total + F.least(F.col("n_authors"), F.lit(5)) * 0.1 + F.when(F.col("year").isNotNull() | F.col("published").isNotNull(), 0.3).otherwise(0.0)
    return total + F.when(F.coalesce("has_code", F.lit(False)), 0.5).otherwise(0.0) + F.when(F.coalesce("has_pdf", F.lit(False)), 0.3).otherwise(0.0) + bonus


FILLED = ("year", "published", "doi", "publisher", "description", "summary", "stars", "downloads")


def merged_by_key(sources: DataFrame, alternates: int = 5) -> DataFrame:
    """One record a key.  The best one (by quality, then input order) gives id, title, url, platform and kind; the abstract is the longest, the
    citations the most, code is known if any knows it, other fields are the first that is not null or empty, in order of quality; authors are
    all names, each in its first spelling, urls the first ``alternates`` different ones.

    Keys and qualities are worked out once, and written with the short fields; abstracts, which are most of a record, are neither written nor
    aggregated: the place of the longest is found by its length, and it is joined back by ``ordinal``, which no two records share.  Fields are
    aggregates that combine before the shuffle.  Names are reduced to one row each before they meet, and urls to the first few of
    each part of a key and then of the key, so a key with very many records is no task's burden but by its number of names."""
    spark = sources.sparkSession
    folder = store.new_folder(spark, "merge")
    place = F.struct((-F.col("q")).alias("a"), F.col("ordinal").alias("b"))
    best = ("source_id", "title", "url", "platform", "source_type", "ordinal", "has_code")
    thin = sources.select(dedupe_key().alias("key"), quality().alias("q"), F.length(F.coalesce("abstract", F.lit(""))).alias("n"), "authors_raw", "citation_count", *best, *FILLED)
    thin.write.parquet(folder)
    rows = spark.read.schema(thin.schema).parquet(folder)
    first = lambda c: F.min(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.struct(place.alias("p"), F.col(c).alias("v"))))["v"].alias(c)
    main = rows.groupBy("key").agg(
        F.min(F.struct(place.alias("p"), *best)).alias("best"), F.max(F.struct("n", "q", (-F.col("ordinal")).alias("o")))["o"].alias("_longest"), F.max("citation_count").alias("citation_count"),
        F.bool_or(F.coalesce("has_code", F.lit(False))).alias("_code"), *map(first, FILLED), F.round(F.max("q"), 6).alias("quality"), F.count("*").alias("duplicate_count"),
    )
    main = main.select("key", *[F.col(f"best.{c}") for c in best[:-1]], F.when(F.col("_code"), True).otherwise(F.col("best.has_code")).alias("has_code"), (-F.col("_longest")).alias("_longest"), "citation_count", *FILLED, "quality", "duplicate_count")
    names = rows.select("key", place.alias("p"), F.posexplode(F.split("authors_raw", ";")).alias("pos", "name")).where("name <> ''")
    names = names.groupBy("key", F.lower("name").alias("low")).agg(F.min(F.struct("p", "pos", "name")).alias("x"))
    names = names.groupBy("key").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["name"]).alias("authors"))
    urls = rows.groupBy("key", "url").agg(F.min(place).alias("p"))
    urls = first_of_each(urls, "key", [F.asc("p")], alternates).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "url"))), lambda x: x["url"]).alias("alternate_urls"))
    merged = main.join(names, "key", "left").join(urls, "key", "left").withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))
    return merged.join(sources.select(F.col("ordinal").alias("_longest"), "abstract"), "_longest").drop("_longest")


def exact_titles(sources: DataFrame, shortest: int = 8) -> DataFrame:
    """Papers: the best record of each normalized title of enough letters; of what is left, the first record of each id."""
    key = tx.normal_title(F.col("title"))
    rows = sources.withColumn("title_key", key).withColumn("q", quality())
    long_ = (F.col("source_type") == "research_paper") & (F.length("title_key") >= shortest)
    best = rows.where(long_).groupBy("title_key").agg(F.max_by(F.struct("source_id", "ordinal"), F.struct("q", (-F.col("ordinal")).alias("o"))).alias("s")).select("s.*")
    return best.unionByName(rows.where(~long_).select("source_id", "ordinal")).groupBy("source_id").agg(F.min("ordinal").alias("ordinal")).select("source_id")


LONGEST_TITLE = 500  # of valid titles


TILE = 8_192  # titles of one length class that are compared at a time
TILE_CHARS = 1 << 23  # and the most of their characters
LETTERS = " +0123456789abcdefghijklmnopqrstuvwxyz"
CODES = np.array([LETTERS.find(chr(c)) % (len(LETTERS) + 1) for c in range(129)], dtype=np.uint8)  # of characters; all others are one
BITS = 512  # titles up to so many characters are compared as words of bits


def _length_class(n: Column, least_ratio: float) -> Column:
    """Classes of lengths a little wider than the ratio, so that two lengths within it are in one class or in neighbours."""
    return F.floor(F.log(n) / -np.log(least_ratio - 1e-6)).cast("int")


def _tiled(rows: DataFrame, least_ratio: float) -> DataFrame:
    """rows (id, title, block, n), each once for every unit that it is compared in, with the unit (block, low, p, high, q) and whether it stands on the unit's low side.

    A class of a block is dealt into parts of about TILE titles or TILE_CHARS characters; a unit is two parts, of one class or of neighbouring ones, or one part with itself.
    So a title is sent as often as its class and the next ones have parts: once or twice each, until a block has very many titles of like lengths."""
    classed = rows.withColumn("class", _length_class(F.col("n"), least_ratio))
    sizes = classed.groupBy("block", "class").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_CHARS)).cast("int").alias("parts"))  # a row a block and class
    beside = lambda step, name: sizes.select("block", (F.col("class") - step).alias("class"), F.col("parts").alias(name))
    known = sizes.join(beside(1, "above"), ["block", "class"], "left").join(beside(-1, "below"), ["block", "class"], "left")
    dealt = classed.join(F.broadcast(known), ["block", "class"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def units(count: Column, of) -> Column:
        numbers = F.filter(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: i < count)
        return F.transform(numbers, of)

    unit = lambda low, p, high, q, side: F.struct(low.alias("low"), p.alias("p"), high.alias("high"), q.alias("q"), F.lit(side).alias("is_low"))
    c, r, none = F.col("class"), F.col("part"), F.lit(0)
    own = F.concat(units(F.col("parts") - r, lambda i: unit(c, r, c, r + i, True)), units(r, lambda i: unit(c, i, c, r, False)))
    other = F.concat(units(F.coalesce("above", none), lambda i: unit(c, r, c + 1, i, True)), units(F.coalesce("below", none), lambda i: unit(c - 1, i, c, r, False)))
    return dealt.select("id", "title", "block", "n", F.explode(F.concat(own, other)).alias("u")).select("id", "title", "block", "n", "u.*")


def _characters(title: str) -> np.ndarray:
    return np.frombuffer(title.encode("utf-32-le"), dtype=np.uint32)


def _letters(titles: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """How often each letter is in each title, a row a letter, and one for all others; and the letters of titles up to BITS by place, a row a place."""
    longest = min(BITS, pc.max(pc.utf8_length(titles)).as_py() or 0)
    counts = np.zeros((len(titles), len(LETTERS) + 1), dtype=np.uint32)
    codes = np.full((len(titles), longest), len(LETTERS) + 1, dtype=np.uint8)
    for i, t in enumerate(titles.to_pylist()):
        got = CODES[np.minimum(_characters(t), 128)]
        counts[i] = np.bincount(got, minlength=len(LETTERS) + 1)
        if len(got) <= longest:
            codes[i, : len(got)] = got
    return np.ascontiguousarray(counts.T), np.ascontiguousarray(codes.T)


def _common(codes_a: np.ndarray, a: np.ndarray, codes_b: np.ndarray, b: np.ndarray, nb: np.ndarray, least: np.ndarray, each: int = 16) -> np.ndarray:
    """Which of the pairs (columns a and b of the letters by place, nb letters in b) have a common subsequence of the least length: 64 places of a are a word of bits that
    all letters of b are put through in turn (Hyyro's recurrence), for all pairs at once.  A pair goes as soon as what is left of b can't make up for what is missing."""
    used, a = np.unique(a, return_inverse=True)
    longest = int((codes_a[:, used] <= len(LETTERS)).sum(axis=0).max(initial=0))
    words, kinds = -(-longest // 64), len(LETTERS) + 2
    masks = np.zeros((words, len(used) * kinds), dtype=np.uint64)  # where a title has a letter; nowhere, for the places after its end
    for i in range(longest):
        at = codes_a[i, used]
        there = at <= len(LETTERS)
        masks[i // 64, (np.arange(len(used)) * kinds + at)[there]] |= np.uint64(1 << i % 64)
    left, base = np.arange(len(a)), a * kinds
    bits = [np.full(len(a), ~np.uint64(0)) for _ in range(words)]
    found = lambda: sum((np.bitwise_count(~v).astype(np.int32) for v in bits), np.zeros(len(left), dtype=np.int32))
    for i in range(int(nb.max(initial=0))):
        if i % each == 0 and i:
            fits = found() + np.maximum(nb - i, 0) >= least
            if 4 * np.count_nonzero(fits) < 3 * len(fits):
                left, base, b, nb, least, bits = left[fits], base[fits], b[fits], nb[fits], least[fits], [v[fits] for v in bits]
        at, carry = base + codes_b[i, b], None
        for w, v in enumerate(bits):
            u = v & masks[w][at]
            total = v + u
            over = total < u
            if carry is not None:
                total += carry
                over |= total < carry
            carry = over.astype(np.uint64)
            bits[w] = total | (v - u)
    return left[found() >= least]


def _without_ends(a: str, b: str) -> tuple[str, str]:
    """Two texts without the characters that they have in common at the beginning, then at the end."""
    x, y = _characters(a), _characters(b)
    for _ in range(2):
        unlike = np.flatnonzero(x[: len(y)] != y[: len(x)])
        same = unlike[0] if len(unlike) else min(len(x), len(y))
        x, y = x[same:][::-1], y[same:][::-1]
    return x.tobytes().decode("utf-32-le"), y.tobytes().decode("utf-32-le")


def _common_of_long(a: str, b: str, least: int, each: int = 512) -> int:
    """The length of the longest common subsequence, or -1 where it is below the least: the same recurrence for one pair, in one number of as many bits as a has characters."""
    x, y = _characters(a), _characters(b).tolist()
    whole = (1 << len(x)) - 1
    masks, bits, found = {int(c): int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little") for c in np.unique(x)}, whole, 0
    for i, c in enumerate(y, 1):
        u = bits & masks.get(c, 0)
        bits = (bits + u) | (bits - u)
        if i % each == 0 or i == len(y):
            bits &= whole
            found = len(x) - bits.bit_count()
            if found + len(y) - i < least:
                return -1
    return found if found >= least else -1


def _near(common: Callable[[np.ndarray, np.ndarray], np.ndarray], cut: bool, step: int = 256, piece: int = 8_192):
    """The pairs of a unit that can have the least common subsequence, given by the lengths of the longer and of the shorter title: they share as many letters, and then
    have it.  Where the longer one has over BITS characters it is known, and so the number of edits that put letters in or leave them out, which is given with the pair; there, with cut, titles are given without their common ends."""
    names = ["id_a", "id_b", "na", "ta", "tb", "edits"]

    def meet(long_: pa.Table, short: pa.Table, la: tuple[np.ndarray, np.ndarray], lb: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        na, nb = (t.column("n").to_numpy().astype(np.int32) for t in (long_, short))
        ia, ib = (t.column("id").to_numpy() for t in (long_, short))
        if not len(na) or not len(nb):
            return
        kind = np.min_scalar_type(max(na[-1], nb[-1]))  # the smallest that holds a length
        counts = [(p.astype(kind), q.astype(kind)) for p, q in zip(la[0], lb[0], strict=True) if p.any() and q.any()]
        for i in range(0, len(na), step):
            rows = slice(i, i + step)
            # both are in order of length
            columns = slice(int(np.argmax(nb >= common(na[i], nb))), int(np.searchsorted(nb, na[rows][-1], "right")))
            if columns.start >= columns.stop:
                continue
            x, y = na[rows, None], nb[None, columns]
            shared = np.zeros((x.shape[0], y.shape[1]), dtype=kind)
            for p, q in counts:
                shared += np.minimum(p[rows, None], q[None, columns])
            lengths, of = np.unique(na[rows], return_inverse=True)
            # a is the longer one, of equals the one with the smaller id
            fits = (shared >= common(lengths[:, None], y).astype(kind)[of]) & ((x > y) | ((x == y) & (ia[rows, None] < ib[None, columns])))
            at, bt = np.nonzero(fits)
            at, bt = at + i, bt + columns.start
            few = max(1, min(piece, TILE_CHARS // (2 * int(na[rows][-1]))))
            for j in range(0, len(at), few):
                a, b = at[j : j + few], bt[j : j + few]
                least, is_long = common(na[a], nb[b]), na[a] > BITS
                known = np.flatnonzero(~is_long)
                known = known[_common(la[1], a[known], lb[1], b[known], nb[b[known]], least[known])]
                if len(known):
                    x, y = long_.take(pa.array(a[known])), short.take(pa.array(b[known]))
                    yield from pa.table([x["id"], y["id"], x["n"], x["title"], y["title"], pa.nulls(len(known), pa.int32())], names).combine_chunks().to_batches()
                for k in np.flatnonzero(is_long):
                    x, y = long_.slice(a[k], 1), short.slice(b[k], 1)
                    ta, tb = x["title"][0].as_py(), y["title"][0].as_py()
                    u, v = _without_ends(ta, tb)
                    got = _common_of_long(u, v, least[k] - (len(ta) - len(u)))
                    if got >= 0:
                        texts = [pa.array([t], x["title"].type) for t in ((u, v) if cut else (ta, tb))]
                        yield from pa.table([x["id"], y["id"], x["n"], *texts, pa.array([len(u) + len(v) - 2 * got], pa.int32())], names).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = pa.Table.from_batches(list(batches))
        if len(unit) < 2:
            return
        sides = [unit.filter(pc.equal(unit["is_low"], low)).sort_by("n").combine_chunks() for low in (True, False)]
        letters = [_letters(s["title"]) for s in sides]
        low, p, high, q = (unit[k][0].as_py() for k in ("low", "p", "high", "q"))
        if (low, p) == (high, q):
            yield from meet(sides[0], sides[0], letters[0], letters[0])
            return
        yield from meet(sides[1], sides[0], letters[1], letters[0])
        if low == high:
            yield from meet(sides[0], sides[1], letters[0], letters[1])

    return run


def _like(rows: DataFrame, least_ratio: float, common: Callable[[np.ndarray, np.ndarray], np.ndarray], cut: bool = False) -> DataFrame:
    """Pairs (id_a, id_b, na, ta, tb, edits) of titles (id, title, block, n) of one block that may be alike, a the longer one with na characters: of lengths within the
    ratio, and with the least common subsequence (see _near; without edits, all letters outside of LETTERS count as one there).

    Titles of a block meet in units of bounded size, by classes of their lengths; only titles are shuffled, no pairs and no grams.  Units are small and take long, so they
    are dealt to several tasks a core, whatever their bytes."""
    rows = store.written(rows, "titles")
    unit, kind = ["block", "low", "p", "high", "q"], rows.schema["id"].dataType.simpleString()
    tasks = max(8 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _tiled(rows, least_ratio).repartition(tasks, *unit).groupBy(*unit).applyInArrow(_near(common, cut), f"id_a {kind}, id_b {kind}, na int, ta string, tb string, edits int")


def fuzzy_titles(titles: DataFrame, prefix: int = 2, least_ratio: float = 0.85) -> DataFrame:
    """Pairs of distinct titles (id, title) of any length in one block of equal first letters, with 1 - levenshtein / longer length at or above
    the least ratio.  So few edits leave a common subsequence of all other letters of the longer title."""
    rows = titles.groupBy("title").agg(F.min("id").alias("id")).where(F.length("title") > prefix).select("id", "title", F.substring("title", 1, prefix).alias("block"), F.length("title").alias("n"))
    near = _like(rows, least_ratio, lambda na, nb: na - np.floor((1 - least_ratio) * na + 1e-9).astype(np.int32), cut=True)
    # with its bound a distance is given up, as -1, as soon as it is over it
    most = F.floor((1 - least_ratio) * F.col("na") + 1e-9).cast("int")
    found = near.withColumn("most", F.least(most, "edits")).withColumn("d", F.expr("levenshtein(ta, tb, most)")).where(F.col("d") >= 0)
    return found.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), F.round(1 - F.col("d") / F.col("na"), 6).alias("ratio"))


def fuzzy_titles_by_blocks(titles: DataFrame, prefix: int = 2, least_ratio: float = 0.85, shortest: int = 8) -> DataFrame:
    """Pairs of distinct titles (id, title) of at least so many characters in one block of equal first letters (blanks left out), with a matching-block ratio, rounded, at
    or above the least one.

    Matching blocks are a common subsequence, so a ratio of r takes one of r / 2 of both lengths, and lengths down to r / (2 - r) of the longer one.  Nearly all pairs that
    have no such subsequence go before the blocks are looked for.  Where letters outside of LETTERS count as one, the edit distance tells them apart: it is no more than the
    letters put in or left out."""
    rows = titles.groupBy("title").agg(F.min("id").alias("id")).where(F.length("title") >= shortest)
    rows = rows.select("id", "title", F.substring(F.replace("title", F.lit(" ")), 1, prefix).alias("block"), F.length("title").alias("n"))
    least = least_ratio - 1e-6  # the ratio is rounded
    near = _like(rows, least / (2 - least), lambda na, nb: np.ceil(least / 2 * (na + nb) - 1e-9).astype(np.int32))
    pairs = near.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), F.least("ta", "tb").alias("ta"), F.greatest("ta", "tb").alias("tb"), "edits")
    pairs = pairs.withColumn("most", F.floor((1 - least) * (F.length("ta") + F.length("tb"))).cast("int")).where("edits IS NOT NULL OR levenshtein(ta, tb, most) >= 0")
    return pairs.withColumn("ratio", F.round(fz.udf_of("sl_ratio")("ta", "tb"), 6)).where(F.col("ratio") >= least_ratio).select("id_a", "id_b", "ratio")


def without_losers(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """records (id, q) but for those that some pair (id_a, id_b) shows to be a worse copy: of lower quality, or later where both have the
    same.  A record that lost to one that lost itself goes too, as groups keep their best.  Pairs are found once and written."""
    pairs = store.written(pairs.select("id_a", "id_b"), "pairs")
    both = pairs.select(F.col("id_a").alias("id"), F.col("id_b").alias("other")).unionByName(pairs.select(F.col("id_b").alias("id"), F.col("id_a").alias("other")))
    rated = both.join(records.select("id", "q"), "id").join(records.select(F.col("id").alias("other"), F.col("q").alias("oq")), "other")
    losers = rated.where((F.col("oq") > F.col("q")) | ((F.col("oq") == F.col("q")) & (F.col("other") < F.col("id")))).select("id").distinct()
    return records.join(losers, "id", "left_anti")


def normalized(sources: DataFrame, longest: int = 2000, most_authors: int = 50) -> DataFrame:
    """Records in normal form: title of three letters or more, valid url without tracking, abstract cut at ``longest``, authors each once
    whatever their case, years and citations within range, and an id that follows from platform, url and title."""
    title, url = tx.clean(F.col("title")), ul.without_tracking(F.col("url"))
    names = F.filter(F.transform(F.split("authors_raw", ";"), tx.clean), lambda n: n != "")
    rows = sources.withColumns({"title": title, "link": url, "names": F.slice(tx.distinct_ignoring_case(names), 1, most_authors)})
    rows = rows.where((F.length("title") >= 3) & ul.is_valid(F.col("url")))
    canonical = F.to_json(F.struct("platform", F.regexp_replace(F.lower("title"), " +", " ").alias("title"), F.col("link").alias("url")))
    return rows.select(
        F.sha2(canonical, 256).alias("source_id"), "ordinal", "title", F.col("link").alias("url"), "platform", "source_type", F.nullif(F.left(tx.clean(F.col("abstract")), F.lit(longest)), F.lit("")).alias("abstract"), F.col("names").alias("authors"),
        F.when(F.col("year").between(0, 2100), F.col("year")).alias("year"), F.when(F.col("citation_count") >= 0, F.col("citation_count")).alias("citation_count"), "has_code", "difficulty",
    )


def drop_reason(min_title: int = 3, longest_abstract: int = 5000) -> Column:
    """The first rule that a record breaks, or null."""
    title = F.lower(F.col("title"))
    return (
        F.when(F.length("title") < min_title, "title_short").when(F.length("title") > 500, "title_long").when(title.rlike("withdrawn|retracted"), "withdrawn")
        .when(~ul.is_valid(F.col("url")), "url_invalid").when(F.length("abstract") > longest_abstract, "abstract_long").when(~F.coalesce(F.col("year").between(0, 2100), F.lit(True)), "year_range")
    )


def fallback_rungs(scored: DataFrame, strict: Column, relaxed: Column) -> DataFrame:
    """Strict rows if there are any, else relaxed ones, else all: the rung is one aggregate, joined to the rows."""
    rows = scored.withColumn("_s", strict).withColumn("_r", relaxed)
    rung = rows.agg(F.when(F.bool_or("_s"), 1).when(F.bool_or("_r"), 2).otherwise(3).alias("rung"))
    both = rows.crossJoin(F.broadcast(rung))
    return both.where((F.col("rung") == 3) | ((F.col("rung") == 2) & F.col("_r")) | ((F.col("rung") == 1) & F.col("_s"))).drop("_s", "_r")


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """Upsert as a view: the last row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
