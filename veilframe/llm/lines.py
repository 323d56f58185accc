"""Line dedup: lines that equal or nearly equal an earlier line go, by a segment-partition edit join.

Lines are cut at line breaks. Two lines are alike when at most k edits turn one into the
other, with k = min(``max_edits``, ``rate`` * length of the shorter): by default none below
20 characters, one below 40, else two. Of alike lines the earlier one, by document id and
place, stays; links are judged on the input, so a removed line still removes others.
Blank lines always stay.

Equal lines are settled first, by 128-bit digests. Each remaining distinct line of
length l is cut into k + 1 segments, indexed by (l, number, segment). A line alike but
not shorter must contain one of them, shifted by a few places at most; a line therefore
probes the index with its own pieces at the places the edits still left allow (for two
edits 5, 4 and 3 pieces against lines shorter by 0, 1 and 2). Candidates are verified by
an edit automaton over the 2k + 1 diagonals of the band, run for all diagonals at once on
bits.

A pair leaves the join only if the counts of ten letters, modulo eight, differ by no more
than the edits could change, so lines that merely share a hot segment are dropped inside
it; the join sorts and spills, and adaptive execution splits a segment that many lines
share. Only ids, places, hashes and counts travel; texts are shuffled once, by row, for
every step that needs them, which is why all steps after the first form one plan.

All of it is DataFrame functions. Defined results: null text stays null and has no
lines; an empty text is one blank line; rows without an id come last; where ids are
missing or repeat, rows are numbered by id and input order once, in a written copy; a
document whose lines all go keeps an empty text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import with_position
from ..session import materialize, scratch_path
from .common import query, table

MAX_EDITS = 2
RATE = 0.05
_BREAK = "\n"
_LETTERS = "eantirsohd"  # frequent ones tell most; any ten would do


def allowed(length: Column, max_edits: int, rate: float) -> Column:
    """Edits allowed to a pair whose shorter line has this length."""
    return F.least(F.lit(max_edits), F.floor(length * F.lit(rate)).cast("int"))


def _lines(text: Column) -> Column:
    return F.split(text, _BREAK, -1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value for an expression, so that it is computed once even where the expression loops over it."""
    return F.transform(F.array(value), body)[0]


def _is_blank(line: Column) -> Column:
    return ~line.rlike("[^\\x20\\x09-\\x0D]")


def _numbered(documents: DataFrame, key: str) -> tuple[DataFrame, str | None]:
    """Documents with ``_vf_row``, a number in document order, and the key it replaces.

    Whole-number ids that are complete and unique serve as they are.
    """
    ids = documents.select(F.col(key).alias("doc"))
    if dict(ids.dtypes)["doc"] in ("bigint", "int", "smallint"):
        odd = ids.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where(F.col("doc").isNull() | (F.col("n") > 1))
        if odd.isEmpty():
            # the filter drops nothing; with it every step reads the same shuffle
            return documents.withColumnRenamed(key, "_vf_row").where(F.col("_vf_row").isNotNull()), key
    spark = documents.sparkSession
    path = scratch_path(spark, "lines-documents")
    documents.withColumn("_vf_input", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    keys = stored.select("_vf_input", F.col(key).isNull().alias("nameless"), F.col(key).alias("doc"))
    numbers = with_position(keys, ["nameless", "doc", "_vf_input"], "_vf_row").select("_vf_input", "_vf_row")
    return stored.join(numbers, "_vf_input").drop("_vf_input"), None


def _first_lines(rows: DataFrame) -> DataFrame:
    """``row`` and ``places`` of every line that no earlier line equals."""
    lines = rows.select("row", F.posexplode(_lines(F.col("text"))).alias("place", "line")).where(~_is_blank(F.col("line")))
    digests = lines.select("row", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    first = digests.groupBy("h1", "h2").agg(F.min(F.struct("row", "place")).alias("first"))
    return first.groupBy(F.col("first.row").alias("row")).agg(F.collect_list("first.place").alias("places"))


def _texts(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``row``, ``place`` and ``line`` for the ``places`` of each ``row``."""
    wanted = _let(
        _lines(F.col("text")),
        lambda lines: F.transform("places", lambda p: F.struct(p.alias("place"), F.get(lines, p).alias("line"))),
    )
    return rows.join(places.hint("shuffle_hash"), "row").select("row", F.explode(wanted).alias("w")).select("row", "w.place", "w.line")


_WIDEST = 15  # edits at which the automaton's band still fits 31 bits


def _index(max_edits: int) -> int:
    """Marks index rows where probes have their d, 0 to ``max_edits``."""
    return max(3, max_edits + 1)


def _choices(max_edits: int) -> Column:
    """The pieces to take of a line: edits k, shortness d of the other line (or ``_index``), segment i, shift o of its place."""
    if max_edits > _WIDEST:
        raise ValueError(f"at most {_WIDEST} edits")
    found = []
    for k in range(1, max_edits + 1):
        for i in range(1, k + 2):
            found.append((k, _index(max_edits), i, 0))
            for d in range(k + 1):
                # i - 1 edits can lie before the segment, k + 1 - i after it
                low, high = max(1 - i, d - (k + 1 - i)), min(i - 1, d + (k + 1 - i))
                found += [(k, d, i, o) for o in range(low, high + 1)]
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("kdio", c)]) for c in found])


def _counts(line: Column) -> Column:
    """How often each of the letters occurs, modulo 8, in three bits each."""
    bits = F.lit(0)
    for k, letter in enumerate(_LETTERS):
        count = (F.length(line) - F.length(F.replace(line, F.lit(letter)))).cast("int")
        bits = bits.bitwiseOR(F.shiftleft(count.bitwiseAND(F.lit(7)), 3 * k))
    return bits


def _differ(a: Column, b: Column) -> Column:
    """Least number of changes that explains the difference of two counts."""
    total = F.lit(0)
    for k in range(len(_LETTERS)):
        one, two = (F.shiftright(x, 3 * k).bitwiseAND(F.lit(7)) for x in (a, b))
        gap = F.abs(one - two)
        total = total + F.least(gap, 8 - gap)
    return total


def _pieces(lines: DataFrame, max_edits: int, rate: float) -> DataFrame:
    """Index and probe rows: ``h`` (hash of length, segment number and piece), ``row``, ``place``, ``bits`` (counts, and d above them)."""
    measured = lines.select("row", "place", "line", F.length("line").alias("n"), _counts(F.col("line")).alias("counts"))
    shown = measured.select("*", F.explode(_choices(max_edits)).alias("c"))
    length = F.col("n") - F.col("c.d") % _index(max_edits)  # of the indexed line
    k, i = F.col("c.k"), F.col("c.i")
    fits = shown.where((length > 0) & (allowed(length, max_edits, rate) == k))
    base, rest = F.floor(length / (k + 1)).cast("int"), length % (k + 1)
    short = k + 1 - rest  # so many segments have the base length, the others one more
    start = (i - 1) * base + F.greatest(F.lit(0), i - 1 - short) + F.col("c.o")
    size = base + (i > short).cast("int")
    fits = fits.where((start >= 0) & (start + size <= F.col("n")))
    piece = F.substring("line", start + 1, size)
    wide = "int" if max_edits <= 2 else "bigint"  # the counts take 30 bits, d the others
    bits = F.col("counts").cast(wide).bitwiseOR(F.shiftleft(F.col("c.d").cast(wide), 30))
    return fits.select(F.xxhash64(length, i, piece).alias("h"), "row", "place", bits.alias("bits"))


def _before(a: str, b: str) -> Column:
    """Whether line a comes before line b."""
    row_a, row_b = F.col(f"{a}.row"), F.col(f"{b}.row")
    return (row_a < row_b) | ((row_a == row_b) & (F.col(f"{a}.place") < F.col(f"{b}.place")))


def candidates(rows: DataFrame, firsts: DataFrame, max_edits: int, rate: float) -> DataFrame:
    """Pairs of distinct lines, ``a`` the not longer one, that share a segment and have like letter counts."""
    pieces = _pieces(_texts(rows, firsts), max_edits, rate)
    d_i, d_p = (F.shiftrightunsigned(f"{x}.bits", 30) for x in "ip")
    # one test of both sides' marks keeps the sides alike, so that they share one shuffle
    index = _index(max_edits)
    probed = (d_i + d_p * (index + 1)).isin(*[index + d * (index + 1) for d in range(max_edits + 1)])
    # lines of equal length meet in one direction only
    turned = (d_p > 0) | _before("i", "p")
    near = _differ(F.col("i.bits"), F.col("p.bits")) <= 2 * max_edits
    met = pieces.alias("i").join(pieces.alias("p"), (F.col("i.h") == F.col("p.h")) & probed & turned & near)
    ends = [F.col(f"{x}.{c}").alias(f"{n}_{c}") for x, n in (("i", "a"), ("p", "b")) for c in ("row", "place")]
    return met.select(*ends).distinct()


def _with_ends(pair: Column) -> Column:
    """A pair of texts with the lengths of their shared beginning and, after it, shared end."""
    a, b = pair["a"], pair["b"]
    room = F.least(F.length(a), F.length(b))
    powers = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda e: F.call_function("shiftleft", F.lit(1), 30 - e))

    def head(have: Column, more: Column) -> Column:
        equal = F.substring(a, have + 1, more) == F.substring(b, have + 1, more)
        return F.when((more <= room - have) & equal, have + more).otherwise(have)

    def with_tail(found: Column) -> Column:
        def tail(have: Column, more: Column) -> Column:
            ends = [F.substring(x, F.length(x) - have - more + 1, more) for x in (a, b)]
            return F.when((more <= room - found - have) & (ends[0] == ends[1]), have + more).otherwise(have)

        return F.struct(a.alias("a"), b.alias("b"), found.alias("head"), F.aggregate(powers, F.lit(0), tail).alias("tail"))

    return _let(F.aggregate(powers, F.lit(0), head), with_tail)


def edit_distance(a: Column, b: Column, max_edits: int) -> Column:
    """The edit distance of two texts if at most ``max_edits``, else null.

    An automaton reads b and keeps, for each number of edits, a word of 2 k + 1 bits: bit i
    tells that the characters read so far can be made from the first j + i - k of a, where
    j is their number. Each step moves all diagonals of the band at once.
    """
    k, width = max_edits, 2 * max_edits + 1

    def codes(text: Column) -> Column:
        return F.transform(F.split(text, ""), lambda c: F.ascii(c))

    def agreements(a: Column, b: Column) -> Column:
        def bits(c: Column, j: Column) -> Column:
            found = F.lit(0)
            for i in range(width):
                hit = (j + (i - k) >= 0) & (F.get(a, j + (i - k)) == c)
                found = found.bitwiseOR(F.when(hit, F.lit(1 << i)).otherwise(F.lit(0)))
            return found

        return F.transform(b, bits)

    start = F.struct(*[F.lit(sum(1 << (k + r) for r in range(e + 1))).alias(f"w{e}") for e in range(k + 1)])

    def step(seen: Column, equal: Column) -> Column:
        words: list[Column] = []
        for e in range(k + 1):
            word = seen[f"w{e}"].bitwiseAND(equal)
            if e:  # one edit more: a changed, an added, or a missing character
                fewer = seen[f"w{e - 1}"]
                word = word.bitwiseOR(fewer).bitwiseOR(F.shiftright(fewer, 1)).bitwiseOR(F.shiftleft(words[-1], 1))
            words.append(word.bitwiseAND(F.lit((1 << width) - 1)))
        return F.struct(*[w.alias(f"w{e}") for e, w in enumerate(words)])

    def fewest(seen: Column, end: Column) -> Column:
        answer = F.lit(None).cast("int")
        for e in reversed(range(k + 1)):
            met = F.call_function("shiftright", seen[f"w{e}"], end).bitwiseAND(F.lit(1)) == 1
            answer = F.when(met, F.lit(e)).otherwise(answer)
        return answer

    def run(pair: Column) -> Column:
        end = F.size(pair["a"]) - F.size(pair["b"]) + k
        return F.aggregate(agreements(pair["a"], pair["b"]), start, step, lambda seen: fewest(seen, end))

    def middles(pair: Column) -> Column:
        # an empty middle is split into one empty text, whose code 0 equals no character
        cut = [F.substring(pair[x], pair["head"] + 1, F.length(pair[x]) - pair["head"] - pair["tail"]) for x in "ab"]
        return _let(F.struct(codes(cut[0]).alias("a"), codes(cut[1]).alias("b")), run)

    # equal beginnings and ends do not change the distance
    pair = _let(F.struct(a.alias("a"), b.alias("b")), _with_ends)
    return F.when(F.abs(F.length(a) - F.length(b)) <= k, _let(pair, middles))


def links(rows: DataFrame, firsts: DataFrame, max_edits: int = MAX_EDITS, rate: float = RATE) -> DataFrame:
    """Verified pairs of distinct lines: ``a_row``, ``a_place``, ``b_row``, ``b_place``, ``distance``."""
    pairs = candidates(rows, firsts, max_edits, rate)
    ends = F.array(*[F.struct(F.col(f"{x}_row").alias("row"), F.col(f"{x}_place").alias("place")) for x in "ab"])
    places = pairs.select(F.explode(ends).alias("e")).select("e.*").distinct().groupBy("row").agg(F.collect_list("place").alias("places"))
    shown = _texts(rows, places)
    for x in "ab":
        side = shown.select(F.col("row").alias(f"{x}_row"), F.col("place").alias(f"{x}_place"), F.col("line").alias(x))
        pairs = pairs.join(side, [f"{x}_row", f"{x}_place"])
    found = pairs.withColumn("distance", edit_distance(F.col("a"), F.col("b"), max_edits))
    shorter = F.least(F.length("a"), F.length("b"))
    return found.where(F.col("distance") <= allowed(shorter, max_edits, rate)).drop("a", "b")


def dedup_lines(
    documents: DataFrame, key: str = "doc_id", text: str = "text", max_edits: int = MAX_EDITS, rate: float = RATE
) -> DataFrame:
    """Documents with the lines that stay, and ``n_lines``, ``n_equal`` and ``n_near``: all lines, and those removed of each kind."""
    numbered, renamed = _numbered(documents, key)
    rows = numbered.select(F.col("_vf_row").alias("row"), F.col(text).cast("string").alias("text"))
    firsts = materialize(_first_lines(rows))
    found = links(rows, firsts, max_edits, rate)
    a, b = (F.struct(F.col(f"{x}_row").alias("row"), F.col(f"{x}_place").alias("place")) for x in "ab")
    # never null: without the coalesce a null test would be pushed down to the pairs and compute them anew
    later = F.coalesce(F.greatest(a, b), a)
    late = found.select(later.alias("late")).select(F.coalesce("late.row", F.lit(-1)).alias("row"), "late.place")
    late = late.groupBy("row").agg(F.collect_set("place").alias("late"))
    settled = firsts.join(late, "row", "left").select(F.col("row").alias("_vf_row"), F.col("places").alias("_vf_firsts"), F.col("late").alias("_vf_late"))
    none = F.array().cast("array<int>")
    firsts_of, late_of = F.coalesce("_vf_firsts", none), F.coalesce("_vf_late", none)

    def blanks(lines: Column) -> Column:
        return F.filter(F.transform(lines, lambda line, i: F.when(_is_blank(line), i)), lambda i: i.isNotNull())

    def cut(doc: Column) -> Column:
        stays = F.array_sort(F.concat(doc["blank"], F.array_except(firsts_of, late_of)))
        kept = F.array_join(F.transform(stays, lambda i: F.get(doc["lines"], i)), _BREAK)
        return F.struct(F.size(doc["lines"]).alias("n"), F.size(doc["blank"]).alias("blank"), kept.alias("text"))

    lines_of = _lines(F.col(text).cast("string"))
    settled_doc = _let(_let(lines_of, lambda lines: F.struct(lines.alias("lines"), blanks(lines).alias("blank"))), cut)
    joined = numbered.join(settled.hint("shuffle_hash"), "_vf_row", "left").withColumn("_vf_doc", F.when(F.col(text).isNotNull(), settled_doc))
    zero = F.lit(0)
    result = joined.withColumns(
        {
            "n_lines": F.coalesce(F.col("_vf_doc.n"), zero).cast("bigint"),
            "n_equal": F.coalesce(F.col("_vf_doc.n") - F.col("_vf_doc.blank") - F.size(firsts_of), zero).cast("bigint"),
            "n_near": F.size(late_of).cast("bigint"),
            text: F.col("_vf_doc.text"),
        }
    )
    if renamed:
        result = result.withColumnRenamed("_vf_row", renamed)
    counts = [c for c in ("n_lines", "n_equal", "n_near") if c not in documents.columns]
    return result.select(*documents.columns, *counts)


# DuckDB's levenshtein counts bytes: the few non-ASCII characters are first mapped to control characters.
_BYTES = " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 32), 127])
_EARLIER = "(a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.place < b.place))"
# of one part more than edits, one is untouched
_PARTS = MAX_EDITS + 1
_SHARED = " OR ".join(
    f"contains(b.t, substr(a.t, a.n // {_PARTS} * {i} + 1{f', a.n // {_PARTS}' if i < MAX_EDITS else ''}))" for i in range(_PARTS)
)
OP3_SQL = f"""
WITH doc AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS place FROM doc),
worded AS (SELECT * FROM line WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
firsts AS (SELECT doc_id, place, line FROM worded QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, place) = 1),
odd AS (SELECT coalesce(string_agg(c, ''), '') AS chars
        FROM (SELECT DISTINCT unnest(string_split(line, '')) AS c FROM firsts) WHERE unicode(c) > 127),
d AS (SELECT doc_id, place, length(line) AS n, least({MAX_EDITS}, CAST(floor(length(line) * {RATE}) AS BIGINT)) AS k,
             translate(line, chars, {_BYTES}) AS t FROM firsts, odd),
short AS (SELECT *, unnest(range(k + 1)) AS more FROM d WHERE k > 0),
pair AS (SELECT a.doc_id AS doc_a, a.place AS place_a, b.doc_id AS doc_b, b.place AS place_b, {_EARLIER} AS a_first
         FROM short a JOIN d b ON b.n = a.n + a.more AND (a.more > 0 OR {_EARLIER})
         WHERE ({_SHARED})
           AND levenshtein(a.t, b.t) <= a.k),
near AS (SELECT DISTINCT CASE WHEN a_first THEN doc_b ELSE doc_a END AS doc_id,
                CASE WHEN a_first THEN place_b ELSE place_a END AS place FROM pair),
stay AS (SELECT line.doc_id, line.place, line.line FROM line
         LEFT JOIN firsts USING (doc_id, place) LEFT JOIN near USING (doc_id, place)
         WHERE NOT regexp_matches(line.line, '[^\\x20\\x09-\\x0D]')
            OR (firsts.line IS NOT NULL AND NOT EXISTS (SELECT 1 FROM near z WHERE z.doc_id = line.doc_id AND z.place = line.place))),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY place) AS kept FROM stay GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS worded FROM worded GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS firsts FROM firsts GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_near FROM near GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines,
       coalesce(worded, 0) - coalesce(firsts, 0) AS n_equal, coalesce(n_near, 0) AS n_near,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN doc USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
     LEFT JOIN f USING (doc_id) LEFT JOIN m USING (doc_id)
"""


@query("op3_line_dedup", OP3_SQL)
def op3_line_dedup(spark, sf_dir):
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_equal", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
