"""Spelling variants: an even-partition pigeonhole join of words that one edit tells apart.

A word of m code points is cut into two segments, the first of m div 2. If one inserted, deleted or replaced code point makes two
words equal, that edit lies in one segment, so the other one stands in both words: at the same place in words of equal
length, and, in a word that is one longer, at the same distance from the start (first segment) or from the end (second).
So every word is indexed under its two segments and probes its own length and the one below with as many substrings.

Where a segment is so frequent that its words make many pairs, what is left of these words between the parts already matched is
cut evenly again, and so on: the same rule one step deeper. A word is found by what it shares before and after a gap that halves
with each step, so lists are split by content until they are short or the gap is one code point; none is dropped.
Counts, keys and joins are DataFrame operations; words are far fewer than occurrences, and texts are read once.

Cases: null and empty texts have no words; texts of any length are read whole; a null doc_id is written as nothing in ``<doc_id>:<run>``;
repeated rows count again; of near words of the same n the smallest in code-point order is the form; no words give no rows; other columns
aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._runtime import ascii_lower, discard, materialize, table

RUN = r"[A-Za-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT = 6, 5
#: One occurrence in so many loses a code point.
SLIP = 199
#: A near word is a word's form if it has so many times its occurrences.
RATIO = 5
#: Keys whose words make more pairs than this are split further.
PAIRS = 1024


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words with MIN_LENGTH code points and MIN_COUNT occurrences."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"({RUN}{{{MIN_LENGTH},}})"), F.lit(1))).alias("run"))
    runs = runs.select("id", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % SLIP == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


def _halves(entries: DataFrame) -> DataFrame:
    """Each entry under both segments of its gap: ``ahead`` and ``behind`` code points match, ``gap`` of the shorter word's lie between."""
    first = F.expr("gap div 2").cast("int")
    ways = F.explode(F.array(
        F.struct((F.col("ahead") + first).alias("ahead"), F.col("behind").alias("behind"), (F.col("gap") - first).alias("gap")),
        F.struct(F.col("ahead").alias("ahead"), (F.col("behind") + F.col("gap") - first).alias("behind"), first.alias("gap")),
    ))
    cut = entries.select("word", "n", "longer", ways.alias("way")).select("word", "n", "longer", "way.*")
    return cut.withColumn("shared", F.concat(F.substring("word", F.lit(1), F.col("ahead")), F.expr("right(word, behind)")))


#: Entries meet under these: how much is shared before and after which gap, and what.
KEY = ["ahead", "behind", "gap", "shared"]


def _verified(entries: DataFrame) -> DataFrame:
    """(a, b, na, nb) of entries that meet under a key and differ by one edit: an indexed word with a longer one, or with a greater one of its length."""
    index = entries.where("not longer").select(*KEY, F.col("word").alias("a"), F.col("n").alias("na"))
    probe = entries.select(*KEY, F.col("word").alias("b"), F.col("n").alias("nb"), "longer")
    met = probe.join(index, KEY).where("longer or b > a")
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b", "na", "nb")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, na, nb): every two words that one edit tells apart, once."""
    start = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("longer"))
    entries = start.select("*", F.lit(0).alias("ahead"), F.lit(0).alias("behind"), F.when(F.col("longer"), F.length("word") - 1).otherwise(F.length("word")).alias("gap"))
    found, before = [], None
    while True:
        entries = materialize(_halves(entries), "segments")
        if before is not None:
            discard(before)
        many = entries.groupBy(*KEY).agg(F.count_if(~F.col("longer")).alias("here"), F.count(F.lit(1)).alias("all"))
        hot = materialize(many.where((F.col("here") * F.col("all") > PAIRS) & (F.col("gap") > 1)).select(*KEY), "hot")
        found.append(materialize(_verified(entries.join(hot, KEY, "left_anti")), "pairs"))
        if hot.isEmpty():
            break
        before, entries = entries, entries.join(hot, KEY, "left_semi").drop("shared")
    discard(entries)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every (word, form), by doubling steps; a form has more occurrences than its word, so there are no rings."""
    at = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not at.where("moved").isEmpty():
        on = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        before, at = at, materialize(at.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        discard(before)
    return at.drop("moved")


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = materialize(word_counts(docs), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("other"), F.col("nb").alias("other_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("other"), F.col("na").alias("other_n")))
    best = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    is_form: Column = -F.col("best.less") >= RATIO * F.col("n")
    near = materialize(best.select("word", "n_near", F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "near")
    ends = roots(near.where("form is not null"))
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: CRC-32 by its table of 256 remainders; near words by equal strings after taking one code point out of each, or out of the longer one.
ORACLE = """
with recursive steps(i, k, c) as (
  select i, 0, i::bigint from range(256) r(i)
  union all select i, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from steps where k < 8),
remainders as (select list(c order by i) as of_byte from steps where k = 8),
runs as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{6,}')) as run from documents),
lower_runs as (select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from runs group by all),
bytes as (select *, hex(encode(id || ':' || run)) as x from lower_runs),
hashed as (select id, run, n, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::bigint),
    lambda c, b: xor(c // 256, of_byte[(xor(c % 256, b) + 1)::bigint]), 4294967295), 4294967295) as h from bytes, remainders),
slipped as (select case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from slipped where length(word) >= 6 group by word having sum(n) >= 5),
gaps as (select word, n, k, left(word, k::int - 1) || substr(word, k::int + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as k from words)),
links as (
  select a.word as word, b.word as other, b.n as other_n from gaps a join gaps b on a.rest = b.rest and a.k = b.k and a.word <> b.word
  union select a.word, b.word, b.n from gaps a join words b on a.rest = b.word
  union select b.word, a.word, a.n from gaps a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from links group by word),
near as (select w.word, w.n, n_near, case when other_n >= 5 * w.n then other end as form, case when other_n >= 5 * w.n then other_n end as form_n from words w left join best b on w.word = b.word),
walk as (select word, form, word as root, form as onward from near
  union all select walk.word, walk.form, near.word, near.form from walk join near on walk.onward = near.word)
select near.word, near.form, walk.root, near.n, coalesce(near.n_near, 0)::bigint as n_near, near.form_n
from near join walk on near.word = walk.word where walk.onward is null
"""
