"""The cascade of reviewed rules on names, years and genders: twelve kinds in a fixed order, each seeing what the ones before did.

Each different identity (key, club, year, gender) goes through the kinds once, by an equi-join a kind with the first rules for its
key, club and year; of each kind the first rule that fits counts. Rows take over what their identity became. So no identity
meets more rules than there are genders, however many rules a key has, and nothing is worked out twice for rows alike.

Unknown clubs, years and genders are null: a rule without a gender fits any, one with a gender fits rows without one, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions import domain
from lanewise.operators import core
from lanewise.plans.decisions import person_case, plain_key, surname_first
from lanewise.plans.repair import without_residue
from lanewise.plans.star import Star

QUERIES: dict = {}
ORACLES: dict = {}

#: The kinds in their order, each with how its rules fit and whether they set a year: never, always, or where none is known.
KINDS = (
    ("gender", "same year", "never"),
    ("name_correction", "club", "never"),
    ("ocr_name", "club", "never"),
    ("birth_year", "evidence", "always"),
    ("fuzzy_birth_year", "old year", "always"),
    ("merge_year", "no year", "always"),
    ("missing_year", "club or no year", "always"),
    ("comma_order", "club", "never"),
    ("comma_order_identity", "identity", "never"),
    ("partial_name", "club", "never"),
    ("partial_name_identity", "identity", "unknown"),
    ("fuzzy_identity", "identity", "never"),
)
#: What follows once a name has been put in order.
AFTER_ORDER = ("partial_name_identity", "fuzzy_identity")
RULE = "kind string, rule_order int, old_key string, club_key string, birth_year int, old_year int, gender string, new_name string, new_key string, new_year int, new_gender string"
_STATE = "struct<name:string,key:string,club:string,year:int,gender:string,done:int,kinds:array<string>>"


def with_any_gender(evidence: DataFrame) -> DataFrame:
    """Evidence rules of kind birth_year, each first one of a key and club once more for rows of any gender; own genders go first."""
    first = core.first_by(evidence, ["old_key", "club_key"], F.asc("rule_order")).withColumn("gender", F.lit(None).cast("string"))
    return evidence.where("gender IS NOT NULL").unionByName(first.withColumn("rule_order", F.lit(2**31 - 1)))


#: The ways to fit that ask for the rule's club, and those that ask for a gender: compatible, or the rule's own.
CLUB_WAYS, GENDER_WAYS = ("club", "evidence", "club or no year"), {"compatible": ("club", "old year", "no year", "club or no year", "identity"), "own": ("evidence",)}


def _of(*ways: str) -> list[str]:
    return [k for k, w, _ in KINDS if w in ways]


def first_rules(rules: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(step, of_key, of_club, of_year, rules): of each kind, the first rule of each gender for the identities of a key and, where the
    kind asks for them, of a club and a year. A rule that fits any identity without a year stands at no year, too. So an
    identity meets at most one rule a gender in each kind, however many rules there are."""
    step = F.coalesce(*[F.when(F.col("kind") == k, n) for n, k in enumerate(kinds)])
    used = rules.where(F.col("kind").isin(*kinds) & F.col("old_key").isNotNull()).withColumn("step", step)
    kind, none = F.col("kind"), F.lit(None).cast("int")
    years = (
        F.when(kind.isin(*_of("same year", "club")), F.array("birth_year")).when(kind.isin(*_of("old year")), F.array("old_year"))
        .when(kind.isin(*_of("club or no year", "identity")), F.array_distinct(F.array(F.col("birth_year"), none))).otherwise(F.array(none))
    )
    fields = ["rule_order", "new_key", "new_name", "old_key", "club_key", "birth_year", "old_year", "gender", "new_year", "new_gender", "kind", "step"]
    laid = used.select("step", F.col("old_key").alias("of_key"), F.when(kind.isin(*_of(*CLUB_WAYS)), F.col("club_key")).alias("of_club"), F.explode(years).alias("of_year"), F.col("gender").alias("of_gender"), F.struct(*fields).alias("rule"))
    first = laid.groupBy("step", "of_key", "of_club", "of_year", "of_gender").agg(F.min("rule").alias("rule"))
    return first.groupBy("step", "of_key", "of_club", "of_year").agg(F.collect_list("rule").alias("rules"))


def _moved(s: Column, r: Column) -> Column:
    """The state after a rule that fits. One that changes nothing still counts as its kind's."""
    always = r["kind"].isin(*[k for k, _, y in KINDS if y == "always"])
    unknown = r["kind"].isin(*[k for k, _, y in KINDS if y == "unknown"]) & s["year"].isNull()
    year = F.when(always | unknown, F.coalesce(r["new_year"], s["year"])).otherwise(s["year"])
    gender = F.when(r["kind"] == "gender", r["new_gender"]).otherwise(s["gender"])
    same = ~F.coalesce(r["new_name"].isNotNull() & (r["kind"] != "gender"), F.lit(False)) & year.eqNullSafe(s["year"]) & gender.eqNullSafe(s["gender"])
    kinds = F.when(same, s["kinds"]).otherwise(F.concat(s["kinds"], F.array(r["kind"])))
    return F.struct(F.coalesce(r["new_name"], s["name"]).alias("name"), F.coalesce(r["new_key"], s["key"]).alias("key"), s["club"].alias("club"), year.alias("year"), gender.alias("gender"), r["step"].alias("done"), kinds.alias("kinds")).cast(_STATE)


def _through(rows: DataFrame, rules: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """rows (_key, _club, _year, _gender, _name, _kinds, ...) after the kinds, one after the other."""
    who, way = ["_key", "_club", "_year", "_gender"], {k: w for k, w, _ in KINDS}
    table = core.settled(first_rules(rules, kinds))
    steps = sorted(r.step for r in table.select("step").distinct().collect())  # at most one a kind
    table = core.small_side(table)
    none = F.lit(None)
    start = F.struct(none.alias("name"), F.col("_key").alias("key"), F.col("_club").alias("club"), F.col("_year").alias("year"), F.col("_gender").alias("gender"), F.lit(-1).alias("done"), F.array().cast("array<string>").alias("kinds")).cast(_STATE)
    became = rows.select(*who).where("_key IS NOT NULL").distinct().select(*[F.col(c).alias(f"x{c}") for c in who], start.alias("_s"))
    for step in steps:
        w, s = way[kinds[step]], F.col("_s")
        on = [
            F.col("of_key") == s["key"], F.col("of_club").eqNullSafe(s["club"]) if w in CLUB_WAYS else None,
            s["year"].isNotNull() if w == "evidence" else F.col("of_year").eqNullSafe(s["year"]),
        ]
        met = became.join(table.where(F.col("step") == step), core.all_of(*on), "left")
        sexed = lambda r: domain.compatible(r["gender"], s["gender"]) if w in GENDER_WAYS["compatible"] else r["gender"].isNull() | (r["gender"] == s["gender"]) if w in GENDER_WAYS["own"] else F.lit(True)  # noqa: B023, E731
        found = met.withColumn("_r", F.array_min(F.filter("rules", lambda r: F.coalesce(sexed(r), F.lit(False)))))  # noqa: B023
        became = found.select(*[f"x{c}" for c in who], F.when(F.col("_r").isNotNull(), _moved(s, F.col("_r"))).otherwise(s).alias("_s"))
    same = core.all_of(*[F.col(c).eqNullSafe(F.col(f"x{c}")) for c in who])
    joined = rows.join(became, same, "left")
    hit = F.col("_s").isNotNull()
    new = {"_key": F.col("_s.key"), "_year": F.col("_s.year"), "_gender": F.col("_s.gender"), "_kinds": F.concat("_kinds", F.col("_s.kinds"))}
    return joined.select(*[(F.when(hit, new[c]).otherwise(F.col(c)) if c in new else F.coalesce("_s.name", c) if c == "_name" else F.col(c)).alias(c) for c in rows.columns])


def _renamed(rows: DataFrame, to: Column, tag: str) -> DataFrame:
    """rows that have a key with `to` as their name where it is another one; _is tells where."""
    new = core.settled(rows.withColumn("_new", F.when(F.col("_key").isNotNull(), to)).withColumn("_is", F.coalesce(F.col("_new") != F.col("_name"), F.lit(False))))
    changed = {"_name": F.col("_new"), "_key": plain_key(F.col("_new")), "_kinds": F.concat("_kinds", F.array(F.lit(tag)))}
    return new.select(*[F.when(F.col("_is"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in rows.columns if c != "_is"], "_is")


def curated(rows: DataFrame, rules: DataFrame, name: str = "full_name", club: str = "club_name", year: str = "birth_year", gender: str | None = "gender", keep_order: bool = False) -> DataFrame:
    """rows with name, year and gender as the cascade leaves them, and `changes`: the kinds that changed something, in order.

    rules: columns of RULE. Residue of accents goes first; then the twelve kinds; names without a year are put in the order
    `Surname, Given`, after which two kinds apply once more, unless the source's order is to be kept: then words are cased. A
    table without a gender has no gender rules. Rows whose name has no letters keep all but its residue.
    """
    sexed = gender is not None
    given = {"_n": name, "_c": club, "_y": year} | ({"_g": gender} if sexed else {})
    each = rows.select(*[F.col(c).alias(k) for k, c in given.items()]).distinct()
    sex = F.lower(F.trim("_g")) if sexed else F.lit(None).cast("string")
    out = core.settled(each.select(*given, without_residue(F.col("_n")).alias("_name"), plain_key(F.col("_c")).alias("_club"), F.col("_y").try_cast("int").alias("_year"), sex.alias("_gender")))
    residue = F.when(F.col("_name") != F.col("_n"), F.array(F.lit("residue"))).otherwise(F.array()).cast("array<string>")
    out = out.withColumn("_key", plain_key(F.col("_name"))).withColumn("_kinds", residue)
    kinds = tuple(k for k, *_ in KINDS if sexed or k != "gender")
    out = _renamed(core.settled(_through(out, rules, kinds)), without_residue(F.col("_name")), "residue")
    if not keep_order:
        out = _renamed(out, F.when(F.col("_year").isNull(), surname_first(F.col("_name"))), "order")
        # names that have been put in order meet two kinds again; the others go past them without a key
        again = out.withColumn("_kept", F.col("_key")).withColumn("_key", F.when(F.col("_is"), F.col("_key")))
        out = core.settled(_through(again, rules, AFTER_ORDER).withColumn("_key", F.coalesce("_key", "_kept")).drop("_kept"))
    out = core.settled(_through(out, rules, ("merge_year",)))
    if keep_order:
        out = _renamed(out, person_case(F.col("_name")), "case")
    same = core.all_of(*[F.col(c).eqNullSafe(F.col(k)) for k, c in given.items()])
    keyed = F.col("_key").isNotNull()
    new = {name: F.col("_name"), year: F.when(keyed, F.col("_year").cast(rows.schema[year].dataType)).otherwise(F.col(year))}
    if sexed:
        new[gender] = F.when(F.lower(F.trim(gender)).eqNullSafe(F.col("_gender")), F.col(gender)).otherwise(F.col("_gender"))
    return rows.join(out, same).select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns], F.col("_kinds").alias("changes"))


# --- registered form


def star_rules(s: Star) -> DataFrame:
    """Rules of all kinds between names of parts: a rule for each supplier and each nation."""
    parts = s.raw("part").select("p_partkey", "p_name", "p_brand", "p_size")
    k = F.col("k")
    keys = s.raw("supplier").select(F.col("s_suppkey").alias("k")).unionByName(s.raw("nation").select((F.col("n_nationkey") + 100).alias("k")))
    old, new = (parts.select(*[F.col(c).alias(f"{x}_{c}") for c in parts.columns]) for x in ("old", "new"))
    pairs = keys.join(old, F.col("old_p_partkey") == k).join(new, F.col("new_p_partkey") == k + 1)
    kind = F.element_at(F.array(*[F.lit(k_) for k_, *_ in KINDS]), (k % 12 + 1).cast("int"))
    sex = F.when(k % 5 == 0, "female").when(k % 5 == 1, "male")
    year = F.when(k % 4 > 0, 1940 + F.col("old_p_size")).cast("int")
    named = F.col("kind").isin("gender", "birth_year", "merge_year")
    out = pairs.withColumn("kind", kind).select(
        "kind", k.cast("int").alias("rule_order"), plain_key(F.col("old_p_name")).alias("old_key"), plain_key(F.col("old_p_brand")).alias("club_key"), year.alias("birth_year"), year.alias("old_year"), sex.alias("gender"),
        F.when(~named, F.concat(F.col("new_p_name"), F.lit(", X"))).alias("new_name"), F.when(~named, F.concat(plain_key(F.col("new_p_name")), F.lit(" x"))).alias("new_key"), (1940 + F.col("new_p_size")).cast("int").alias("new_year"),
        F.when(k % 2 == 0, "female").otherwise("male").alias("new_gender"),
    )
    # names lead on: what a rule makes is what the next one starts from
    on = out.withColumn("old_key", F.when(F.col("rule_order") % 3 == 1, F.concat("old_key", F.lit(" x"))).otherwise(F.col("old_key")))
    return with_any_gender(on.where("kind = 'birth_year'")).unionByName(on.where("kind <> 'birth_year'"))


def star_people(s: Star) -> DataFrame:
    k = F.col("p_partkey")
    return s.raw("part").select(k.alias("row_id"), F.concat("p_name", F.when(k % 2 == 0, ", X").otherwise("")).alias("full_name"), F.col("p_brand").alias("club_name"), F.when(k % 3 > 0, 1940 + F.col("p_size")).cast("int").alias("birth_year"), F.when(k % 5 == 0, "female").when(k % 5 == 1, "male").alias("gender"))


def curated_people(s: Star) -> DataFrame:
    """Names, years and genders of all parts after the cascade. Twelve kinds in order have no SQL; tests hold it against plain Python."""
    return curated(star_people(s), star_rules(s)).withColumn("changes", F.array_join("changes", ","))


QUERIES["curated_people"] = lambda spark, sf_dir: curated_people(Star(spark, sf_dir))
