"""Repair of what a page's text layer breaks: lines printed letter by letter, names with misread vowels, doubled accents.

Nothing here is a list of names. What is a word, and which spelling is the better one, is told by a corpus of names: splits by
the words' counts, repairs by an index of each word without one of its vowels. Runs and words are repaired once each, however
often they are printed, and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions import text, times
from lanewise.operators import core
from lanewise.plans.star import STAR_SQL, Star

QUERIES: dict = {}
ORACLES: dict = {}

#: What a letter costs that is in no known word, in thousandths of a bit; words longer than this aren't looked up.
UNKNOWN, LONGEST = 30_000, 24
#: A spelling gives way to one that is at least so many times as frequent, and that is seen so often.
FACTOR, TRUSTED = 5, 3
VOWELS = "aeiou"
# Accents that text layers double or detach, as what they become.
ENYE = {"NÑ": "Ñ", "nñ": "ñ", "(cid:976)": "f", "N(cid:450)": "Ñ", "n(cid:450)": "ñ", "Natacioán": "Natación", "Natacioón": "Natación", "Joseí": "José"}
ACUTE = {"a": "á", "e": "é", "i": "í", "o": "ó", "u": "ú"}


def query(sql: str | None = None, star: bool = True):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Star(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = (STAR_SQL if star else "") + sql
        return f

    return add


def plain(c: Column) -> Column:
    """Small letters without accents: what words are compared by."""
    return F.lower(text.strip_accents(c))


def mended(c: Column) -> Column:
    """A text whose accents are right again: an ñ printed with its n or behind a stray mark, a vowel followed by its own accented
    form or by a detached í, in a word or before its end. White space is single; nothing left is null."""
    out = F.trim(F.regexp_replace(c, r"\s+", " "))
    for bad, good in ENYE.items():
        out = F.replace(out, F.lit(bad), F.lit(good))
    out = F.regexp_replace(out, r"(?<=[Ññ]) (?=[aeiou])", "")
    for vowel in "aeo":  # the accent stands as an í behind its vowel
        out = F.regexp_replace(out, rf"{vowel} ?í(?=[b-df-hj-np-tv-zñ]|(?i:[b-df-hj-np-tv-zñ]))", ACUTE[vowel])
        if vowel != "a":
            out = F.regexp_replace(out, rf"(?<=[A-Za-zÑñ]){vowel} í(?![\p{{L}}])", ACUTE[vowel])
    for vowel, accented in ACUTE.items():
        out = F.regexp_replace(out, f"{accented}[{vowel}{accented if vowel == 'i' else ''}]", accented)
        out = F.regexp_replace(out, f"{accented.upper()}{vowel.upper()}", accented.upper())
    return text.blank_to_null(F.regexp_replace(out, r"\s+", " "))


# --- lines printed letter by letter


def word_costs(names: DataFrame, column: str) -> DataFrame:
    """(word, cost): the words of a corpus of names with their information in thousandths of a bit, in whole numbers."""
    words = names.select(F.explode(F.split(plain(F.col(column)), r"[^\p{L}]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    total = words.agg(F.sum("n").alias("total"))  # one row
    return words.join(F.broadcast(total)).select("word", F.round(F.log2(F.col("total") / F.col("n")) * 1000).cast("long").alias("cost"))


def best_splits(runs: DataFrame, costs: DataFrame, run: str = "run") -> DataFrame:
    """(run, ends): where the words of each different run of letters end, by the split of least cost; of equal ones that with fewer
    words, then the one whose words end earlier.

    All stretches of a run meet the corpus by an equi-join; a fold over the run's places then keeps the best split up to each.
    Stretches that are no word cost UNKNOWN a letter, and letters that follow each other in such a stretch are one word.
    """
    each = runs.select(F.col(run).alias("run")).where("run IS NOT NULL AND run <> ''").distinct()
    n = F.length("run")
    starts = each.select("run", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    spans = starts.select("run", "start", F.explode(F.sequence(F.col("start") + 1, F.least(n, F.col("start") + LONGEST))).alias("end"))
    words = spans.withColumn("word", F.substring("run", F.col("start") + 1, F.col("end") - F.col("start"))).join(core.small_side(costs), "word")
    known = words.groupBy("run").agg(F.collect_list(F.struct("end", "start", "cost")).alias("words"))
    whole = each.join(known, "run", "left").withColumn("words", F.coalesce("words", F.array().cast("array<struct<end:int,start:int,cost:bigint>>")))
    # of each place: the best split up to it, and whether its last letter is in no word
    kind = "array<struct<cost:bigint,n:int,ends:array<int>,loose:boolean>>"

    def step(best: Column, at: Column) -> Column:
        by_word = F.transform(
            F.filter("words", lambda w: w["end"] == at),
            lambda w: F.struct((F.get(best, w["start"])["cost"] + w["cost"]).alias("cost"), (F.get(best, w["start"])["n"] + 1).alias("n"), F.concat(F.get(best, w["start"])["ends"], F.array(at)).alias("ends"), F.lit(False).alias("loose")),
        )
        last = F.get(best, at - 1)
        joined = F.concat(F.slice(last["ends"], F.lit(1), F.size(last["ends"]) - 1), F.array(at))
        loose = F.struct(
            (last["cost"] + UNKNOWN).alias("cost"), (last["n"] + F.when(last["loose"], 0).otherwise(1)).alias("n"), F.when(last["loose"], joined).otherwise(F.concat(last["ends"], F.array(at))).alias("ends"), F.lit(True).alias("loose")
        )
        return F.concat(best, F.array(F.array_min(F.concat(by_word, F.array(loose)))))

    first = F.array(F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("ends"), F.lit(False).alias("loose"))).cast(kind)
    folded = F.aggregate(F.sequence(F.lit(1), n), first, lambda best, at: step(best, at).cast(kind))
    return whole.select(F.col("run").alias(run), F.element_at(folded, -1)["ends"].alias("ends"))


#: A run of single letters, at least four; of single digits and the marks of a time, at least three.
RUNS = r"(?<!\S)((?:\p{L}\s+){3,}\p{L}|(?:[\d:.,]\s+){2,}[\d:.,])(?!\S)"


def unbroken(lines: DataFrame, costs: DataFrame, line: str = "raw_line") -> DataFrame:
    """lines with `line` put together again: letters that are printed one by one become the words of their best split, digits and
    marks that are printed one by one become a time, if they are one. Other lines stay as they are."""
    broken = F.col(line).rlike(RUNS)
    each = lines.where(broken).select(F.col(line).alias("_line")).distinct().select("_line", F.posexplode(F.split(F.regexp_replace("_line", RUNS, "\u0001$1\u0001"), "\u0001")).alias("at", "part"))
    tight = F.regexp_replace("part", r"\s+", "")
    letters = each.withColumn("tight", F.when(F.col("at") % 2 == 1, tight)).withColumn("run", F.when(F.col("tight").rlike(r"^\p{L}+$"), plain(F.col("tight"))))
    split = letters.join(best_splits(letters, costs), "run", "left")
    begins = F.concat(F.array(F.lit(0)), F.slice("ends", F.lit(1), F.size("ends") - 1))
    words = F.array_join(F.zip_with(begins, F.col("ends"), lambda a, b: F.substring(F.col("tight"), a + 1, b - a)), " ")
    time = F.col("tight").rlike("[:.,]") & times.time_ms(F.col("tight")).isNotNull()
    mended_part = F.when(F.col("run").isNotNull(), words).when(time, F.col("tight")).otherwise(F.col("part"))
    whole = split.withColumn("part", mended_part).groupBy("_line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"]), "").alias("_new"))
    out = lines.join(whole, F.col(line) == F.col("_line"), "left")
    return out.select(*[F.coalesce("_new", line).alias(c) if c == line else F.col(c) for c in lines.columns])


# --- misread vowels


def name_words(names: DataFrame, column: str) -> DataFrame:
    """(word, n, spelling): the plain words of names, how often they are seen, and how they are spelt most often."""
    seen = names.select(F.explode(F.split(F.col(column), r"[^\p{L}]+")).alias("spelling")).where("spelling <> ''").groupBy("spelling").agg(F.count("*").alias("k"))
    return seen.groupBy(plain(F.col("spelling")).alias("word")).agg(F.sum("k").alias("n"), F.max_by("spelling", F.struct("k", "spelling")).alias("spelling"))


def neighbourhood(word: Column) -> Column:
    """A word, and the word without each one of its vowels."""
    places = F.filter(F.sequence(F.lit(1), F.length(word)), lambda k: F.substring(word, k, F.lit(1)).isin(*VOWELS))
    less = F.transform(places, lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), less))


def better_spellings(words: DataFrame) -> DataFrame:
    """(word, better): for each word (word, n) the most frequent one that differs by a vowel too many, too few or misread, and that
    is FACTOR times as frequent and TRUSTED; of equally frequent ones the least. Words meet in the index of their
    neighbourhoods, never pair by pair."""
    index = words.where("length(word) > 1").select("word", "n", F.explode(neighbourhood(F.col("word"))).alias("key"))
    good = index.where(F.col("n") >= TRUSTED).select(F.col("word").alias("better"), F.col("n").alias("m"), "key")
    pairs = index.join(good, "key").where((F.col("word") != F.col("better")) & (F.col("m") >= FACTOR * F.col("n")))
    return pairs.groupBy("word").agg(F.max_by("better", F.struct("m", F.translate("better", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"))).alias("better"))


def repairs(names: DataFrame, column: str, most_rounds: int = 20) -> DataFrame:
    """(word, to, spelling): what the misread words of names become once no further repair applies. Each round repairs what the one
    before has left, with the counts that it has led to; every round has fewer different words, so rounds end."""
    words = name_words(names, column)
    known = words.select("word", "spelling")
    out = words.select("word", F.col("word").alias("to"), "n")
    for _ in range(most_rounds):
        found = core.closure(better_spellings(out.groupBy(F.col("to").alias("word")).agg(F.sum("n").alias("n"))), "word", "better")
        if found.isEmpty():
            break
        new = out.join(found.select(F.col("word").alias("to"), "better"), "to", "left").select("word", F.coalesce("better", "to").alias("to"), "n")
        out = core.settled(new)
    else:
        raise ValueError(f"repairs go on after {most_rounds} rounds")
    return out.where("word <> to").join(known.select(F.col("word").alias("to"), "spelling"), "to").select("word", "to", "spelling")


def repaired(names: DataFrame, column: str, fixes: DataFrame) -> DataFrame:
    """names with every misread word of `column` in its better spelling; what stands between words stays."""
    # words and what lies between them, so that joining the parts gives the name
    each = names.select(F.col(column).alias("_name")).distinct().select("_name", F.posexplode(F.regexp_extract_all("_name", F.lit(r"\p{L}+|[^\p{L}]+"), 0)).alias("at", "part"))
    mapped = each.withColumn("word", plain(F.col("part"))).join(core.small_side(fixes.select("word", "spelling")), "word", "left")
    whole = mapped.groupBy("_name").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("spelling", "part").alias("part")))).alias("p"), F.bool_or(F.col("spelling").isNotNull()).alias("_any"))
    new = whole.where("_any").select("_name", F.array_join(F.transform("p", lambda p: p["part"]), "").alias("_new"))
    return names.join(new, F.col(column) == F.col("_name"), "left").select(*[F.coalesce("_new", column).alias(c) if c == column else F.col(c) for c in names.columns])


# --- registered forms


@query("""SELECT p_partkey, p_size || ' ' || p_name || ' (' || p_brand || ') 1:' || (p_partkey % 50 + 10) || ',' || (p_size + 10) AS line FROM part""", star=False)
def unbroken_lines(s: Star) -> DataFrame:
    """Lines whose names and times are printed letter by letter, put together by what the parts' names consist of."""
    spaced = lambda c: F.regexp_replace(F.regexp_replace(c, " ", ""), r"(?<=.)(?=.)", " ")
    time = F.concat(F.lit("1:"), (F.col("p_partkey") % 50 + 10).cast("string"), F.lit(","), (F.col("p_size") + 10).cast("string"))
    line = F.concat_ws(" ", F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(spaced(F.col("p_name"))), F.concat(F.lit("("), F.col("p_brand"), F.lit(")")), F.when(F.col("p_partkey") % 3 == 0, time).otherwise(spaced(time)))
    printed = s.raw("part").select("p_partkey", line.alias("line"))
    return unbroken(printed, word_costs(s.raw("part"), "p_name"), "line")


@query("""WITH printed AS (SELECT p_partkey, CASE p_partkey % 13 WHEN 0 THEN regexp_replace(p_name, '^([^aeiou]*[aeiou])', '\\1i') WHEN 1 THEN regexp_replace(p_name, '^([^aeiou]*)[aeiou]', '\\1') WHEN 2 THEN regexp_replace(p_name, '[aeiou]([^aeiou]*)$', 'u\\1') ELSE p_name END AS name FROM part),
word AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(name, ' ')) AS word FROM printed) GROUP BY 1),
near AS (SELECT word, n, list_distinct(list_concat([word], [word[1:k - 1] || word[k + 1:] FOR k IN range(1, length(word) + 1) IF contains('aeiou', word[k])])) AS keys FROM word WHERE length(word) > 1),
best AS (SELECT a.word, arg_min(b.word, {'n': -b.n, 'w': b.word}) AS better FROM near a JOIN near b ON a.word <> b.word AND b.n >= 3 AND b.n >= 5 * a.n AND list_has_any(a.keys, b.keys) GROUP BY a.word)
SELECT p_partkey, string_agg(coalesce(better, w), ' ' ORDER BY k) AS name FROM (SELECT p_partkey, unnest(string_split(name, ' ')) AS w, generate_subscripts(string_split(name, ' '), 1) AS k FROM printed) LEFT JOIN best ON word = w GROUP BY p_partkey""", star=False)
def repaired_names(s: Star) -> DataFrame:
    """Part names misread in three ways (a vowel too many, one lost, one changed) in the spelling that the others have."""
    k, name = F.col("p_partkey") % 13, F.col("p_name")
    misread = (
        F.when(k == 0, F.regexp_replace(name, "^([^aeiou]*[aeiou])", "$1i")).when(k == 1, F.regexp_replace(name, "^([^aeiou]*)[aeiou]", "$1")).when(k == 2, F.regexp_replace(name, "[aeiou]([^aeiou]*)$", "u$1")).otherwise(name)
    )
    printed = s.raw("part").select("p_partkey", misread.alias("name"))
    return repaired(printed, "name", repairs(printed, "name"))


# --- residue of accents in names


def without_residue(c: Column) -> Column:
    """A name without what misread accents leave: an ñ split in two, a vowel doubled by an accented one, a first vowel parted from
    its word, the rest behind a bracket that nothing closes.

    Vowels are settled in one fold over the characters, each seeing what the ones before have become, so doing it again changes
    nothing: behind a plain vowel an accented one goes (iá stays), two accented ones lose their accents."""
    from_, to = "áéíóúüÁÉÍÓÚÜ", "aeiouuAEIOUU"
    bare = lambda x: F.translate(x, from_, to)

    def step(done: Column, x: Column) -> Column:
        last = F.right(done["out"], F.lit(1))
        meets = done["open"] & F.contains(F.lit(from_), x) & F.lower(bare(last)).isin(*VOWELS)
        kept, marked = last.isin("i", "I") & x.isin("á", "Á"), F.contains(F.lit(from_), last)
        both = F.concat(F.substring(done["out"], F.lit(1), F.length(done["out"]) - 1), bare(last), bare(x))
        out = F.when(~meets | kept, F.concat(done["out"], x)).when(marked, both).otherwise(done["out"])
        return F.struct(out.alias("out"), (~(meets & kept)).alias("open"))

    first = F.struct(F.lit("").cast("string").alias("out"), F.lit(True).alias("open"))
    meeting = f"[aeiouAEIOU{from_}][{from_}]"
    settle = lambda t: F.when(t.rlike(meeting), F.aggregate(F.split(t, ""), first, step, lambda s: s["out"])).otherwise(t)
    opened = lambda t: F.regexp_count(t, F.lit(r"\(")) > F.regexp_count(t, F.lit(r"\)"))
    closed = lambda t: F.when(opened(t), F.regexp_replace(F.split_part(t, F.lit("("), F.lit(1)), "[ ,]+$", "")).otherwise(t)

    def of(t: Column) -> Column:
        settled = times.let(F.regexp_replace(t, r"(?i)ñ\s+ñ|n\s+ñ|ñ\s+n", "ñ"), settle)
        joined = F.regexp_replace(settled, r"(?U)\b([AEIOUaeiou])\s+(?=[a-zñ])", "$1")
        return F.coalesce(text.blank_to_null(F.regexp_replace(times.let(joined, closed), r"\s+", " ")), t)

    return times.let(mended(c), of)
