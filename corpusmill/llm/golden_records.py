"""Problem 4: the best representative of each duplicate group, field by field.

Method: fields are unpivoted to long rows, and every usable value's row votes with the trust of its origin and its
recency. Votes are summed per value key, winners are chosen by max_by and pivoted back (elect). What a value key
is, is a parameter: consensus_values takes the normalised value and weighs trust by a half-life; survivors, whose wanted order is
lexicographic, lets every member stand for itself, with a vote in which any gain in trust outweighs any gain in recency.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import strip
from corpusmill.llm.cells import entered_values, is_placeholder
from corpusmill.sources.tables import table

FIELDS = ["author", "published", "description", "tags"]
TRUST = {"curated": 3, "classified": 2, "fetched": 1}
HALF_LIFE_DAYS = 365.0
LAST_DAY = "2025-12-31"
FIRST_DAY = "2010-01-01"
#: A sentence is page furniture if it stands under so many different titles, and under this share of all titles.
FURNITURE_TITLES, FURNITURE_SHARE = 8, 0.001
#: A description of which this share of words is furniture doesn't speak about its source.
FURNITURE_WORDS = 0.5
_MONTHS = "january february march april may june july august september october november december".split()
_DAY_MICROS = 86_400_000_000
#: Votes are whole numbers: microseconds of updated_at, and for trust more than any timestamp has; null is older than all.
_TRUST_VOTE, _NULL_VOTE = 10**18, -(10**17)
#: Words for roles instead of persons.
_ROLES = "admin administrator anonymous author authors contributor contributors editor editors editorial guest redaktion staff team user webmaster".split()


def trust_of(origin: Column) -> Column:
    """3, 2, 1 for curated, classified, fetched in any case and with outer blanks; 0 for null and anything else."""
    o = F.lower(strip(origin))
    return F.coalesce(reduce(lambda w, t: w.when(o == t[0], t[1]), list(TRUST.items())[1:], F.when(o == "curated", 3)), F.lit(0))


def whole_day(c: Column) -> Column:
    """The one calendar day a text gives, as a date, whatever the notation; null if there is none or it doesn't exist."""
    t = F.lower(strip(F.regexp_replace(c, r"(?U)\s+", " ")))
    time = r"(?:[t ,]+(?:at )?\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?: ?[ap]m)?(?: ?(?:z|utc|gmt))?(?: ?[+-]\d{2}:?\d{2})?)?"
    week = r"(?:(?:mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(?:day)?\.?,? )?"
    month = "(" + "|".join(f"{m[:3]}(?:{m[3:]}|t)?" if len(m) > 3 else m for m in _MONTHS) + ")"
    shapes = [
        (rf"^{week}(\d{{4}})[-/. ](\d{{1,2}})[-/. ](\d{{1,2}}){time}$", (1, 2, 3), False),
        (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:t?\d{{4,6}}z?)?$", (1, 2, 3), False),
        (rf"^{week}(\d{{1,2}})\. ?(\d{{1,2}})\. ?(\d{{4}}){time}$", (3, 2, 1), False),
        (rf"^{week}(\d{{1,2}})(?:st|nd|rd|th)?[- .]+(?:of )?{month}\.?,?[- ](\d{{4}}){time}$", (3, 2, 1), True),
        (rf"^{week}{month}\.?[- ](\d{{1,2}})(?:st|nd|rd|th)?,?[- ](\d{{4}}){time}$", (3, 1, 2), True),
        (rf"^(\d{{4}})[-, ]+{month}\.?[- ](\d{{1,2}})(?:st|nd|rd|th)?{time}$", (1, 2, 3), True),
    ]
    days = []
    for pattern, (y, m, d), named in shapes:
        part = lambda g: F.regexp_extract(t, pattern, g)  # noqa: B023, E731
        mon = part(m)
        if named:
            mon = F.coalesce(*[F.when(mon.startswith(name[:3]), F.lit(str(i))) for i, name in enumerate(_MONTHS, 1)])
        days.append(F.when(F.regexp_like(t, F.lit(pattern)), F.try_to_date(F.concat_ws("-", part(y), F.lpad(mon, 2, "0"), F.lpad(part(d), 2, "0")), "yyyy-MM-dd")))
    return F.coalesce(*days)


def names_people(c: Column) -> Column:
    """True if the text is one or more persons' names: each of two words or more, capitalised or initials, without digits, addresses or words for roles."""
    t = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    people = F.filter(F.split(F.regexp_replace(t, r"(?i),? (?:and|und|et|y|with) | & ", ";"), ";|/|,"), lambda x: F.trim(x) != "")
    word = r"(?:\p{Lu}[\p{L}\p{M}'’]*(?:-\p{Lu}[\p{L}\p{M}'’]*)*\.?)"
    particle = r"(?:van|von|de|der|den|del|della|di|da|dos|du|la|le|bin|ibn|al|el|ter|ten|zu|y|e)"
    pattern = rf"^(?:(?:dr|prof|mr|mrs|ms)\.? )?{word}(?: {particle})*(?: {word}(?: {particle})*)*[ ]{word}(?:,? (?:jr|sr|ii|iii|phd)\.?)?$"
    roles = F.arrays_overlap(F.split(F.lower(t), r"(?U)[^\p{L}]+"), F.array(*[F.lit(w) for w in _ROLES]))
    ok = F.forall(people, lambda x: F.regexp_like(F.trim(x), F.lit(pattern)))
    return ~is_placeholder(c) & ~F.regexp_like(t, F.lit(r"\d|://|@|\w\.\w{3,}")) & ~roles & (F.size(people) > 0) & ok


def sentences_of(c: Column) -> Column:
    """Array of (s, words): a digest of each sentence's letters and digits in lower case, and its number of words."""
    plain = F.transform(F.split(F.lower(c), r"(?U)[.!?\n\r]+(?:\s+|$)"), lambda x: F.trim(F.regexp_replace(x, r"(?U)[^\p{L}\p{M}\p{N}]+", " ")))
    return F.transform(F.filter(plain, lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("s"), F.size(F.split(x, " ")).alias("words")))


def furniture(sources: DataFrame) -> DataFrame:
    """s: digests of the sentences that stand under many different titles: menus, consent, login, error and loading pages.

    A sentence about one source is repeated by that source's copies, whose titles differ in form only, so
    titles are compared by their letters and digits. A sentence needs FURNITURE_TITLES titles and FURNITURE_SHARE of
    all; so there are at most as many as a source has sentences on average, divided by FURNITURE_SHARE.
    """
    title = F.xxhash64(F.regexp_replace(F.lower("title"), r"(?U)[^\p{L}\p{M}\p{N}]+", " "))
    rows = sources.where("description IS NOT NULL").select(title.alias("t"), "description")
    least = F.greatest(F.lit(FURNITURE_TITLES), F.lit(FURNITURE_SHARE) * F.col("n"))
    all_titles = rows.agg(F.approx_count_distinct("t").alias("n"))
    spread = rows.select("t", F.explode(sentences_of(F.col("description"))).alias("x")).groupBy("x.s").agg(F.count_distinct("t").alias("titles"))
    return spread.crossJoin(F.broadcast(all_titles)).where(F.col("titles") >= least).select("s")  # one row


def furnished(rows: DataFrame, known: DataFrame) -> DataFrame:
    """row_id and furnished, the share of its description's words that stand in known furniture; rows with a description only."""
    split = rows.select("row_id", F.explode(sentences_of(F.col("description"))).alias("x")).select("row_id", "x.s", "x.words")
    marked = split.join(F.broadcast(known.withColumn("known", F.lit(True))), "s", "left")  # bounded, see furniture
    return marked.groupBy("row_id").agg((F.sum(F.when(F.col("known"), F.col("words")).otherwise(0)) / F.sum("words")).alias("furnished"))


def candidates(report: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per group, member and field: group_id, row_id, field, value, usable, score, trust, seen (microseconds of updated_at or null).

    report rows may repeat; members without a row in sources have no candidates. Extra columns are ignored.
    What furniture is, is learned from all sources' descriptions.
    """
    members = report.select("group_id", "row_id").where("group_id IS NOT NULL AND row_id IS NOT NULL").distinct()
    rows = members.join(sources.select("row_id", *FIELDS, "origin", "updated_at"), "row_id").join(furnished(sources, furniture(sources)), "row_id", "left")
    seen = F.unix_micros("updated_at")
    day = whole_day(F.col("published"))
    limit = F.coalesce(F.floor(seen / _DAY_MICROS), F.unix_date(F.lit(LAST_DAY).cast("date")).cast("bigint"))
    dated = F.coalesce((day >= F.lit(FIRST_DAY).cast("date")) & (F.unix_date(day) <= limit), F.lit(False))
    tags = entered_values(F.col("tags"))
    n_tags = F.size(F.array_distinct(F.transform(tags, F.lower)))
    real_tags = F.exists(tags, lambda x: ~is_placeholder(x))
    option = lambda name, value, usable, score: F.struct(F.lit(name).alias("field"), value.alias("value"), F.coalesce(usable, F.lit(False)).alias("usable"), score.cast("bigint").alias("score"))
    text = strip(F.col("description"))
    long = F.explode(
        F.array(
            option("author", strip(F.col("author")), names_people(F.col("author")), F.lit(0)),
            option("published", day.cast("string"), dated, F.lit(0)),
            option("description", text, ~is_placeholder(F.col("description")) & (F.coalesce("furnished", F.lit(1.0)) < FURNITURE_WORDS), F.length(text)),
            option("tags", F.array_join(tags, ", "), real_tags, n_tags),
        )
    )
    return rows.select("group_id", "row_id", trust_of(F.col("origin")).alias("trust"), seen.alias("seen"), long.alias("o")).select("group_id", "row_id", "o.*", "trust", "seen")


def elect(long: DataFrame, key: Column, vote: Column) -> DataFrame:
    """group_id, field, row_id, value, votes: per group and field the value key with the highest score, then the largest sum of votes, then the smallest row_id.

    Only usable rows vote. value and row_id are those of the key's smallest row_id. No row where nothing is
    usable. Sums and maxima are combined map-side, so a group of any size costs one row per task and key.
    """
    first = F.struct("row_id", "value")
    tally = long.where("usable").groupBy("group_id", "field", key.alias("key")).agg(F.max("score").alias("score"), F.sum(vote).alias("votes"), F.min_by(first, "row_id").alias("w"))
    rank = F.struct("score", "votes", (-F.col("w.row_id")).alias("least"))
    return tally.groupBy("group_id", "field").agg(F.max_by(F.struct("w", "votes"), rank).alias("e")).select("group_id", "field", "e.w.row_id", "e.w.value", "e.votes")


def survivors(long: DataFrame) -> DataFrame:
    """group_id, field, row_id, value: the winner of each field; no row where no member is usable.

    Higher score first, then trust, then the latest seen (null is oldest), then the smallest row_id: every
    member is a key of its own, and its vote is trust times more than any timestamp, plus its microseconds.
    """
    vote = (F.col("trust") * _TRUST_VOTE + F.coalesce("seen", F.lit(_NULL_VOTE))).cast("decimal(20,0)")
    return elect(long, F.col("row_id"), vote).drop("votes")


def normal_value(c: Column) -> Column:
    """Letters and digits in lower case: the key under which values count as the same."""
    return F.lower(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}]+", " "))


def consensus_values(long: DataFrame, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """group_id, field, value, votes: per field the normalised value with the largest sum of trust times recency decay.

    A vote is (trust + 1) * 0.5 ** (age / half_life), age in days before the group's latest update; a null
    update counts as ten half-lives. Ties go to the value of the smaller row_id.
    """
    newest = long.groupBy("group_id").agg(F.max("seen").alias("newest"))
    age = F.coalesce((F.col("newest") - F.col("seen")) / F.lit(float(_DAY_MICROS)), F.lit(10.0 * half_life_days))
    vote = F.round((F.col("trust") + 1) * F.pow(F.lit(0.5), age / F.lit(half_life_days)), 9).cast("decimal(20,9)")  # exact sums, in any order
    won = elect(long.withColumn("score", F.lit(0)).join(newest, "group_id"), normal_value(F.col("value")), vote)
    return won.select("group_id", "field", "value", F.round("votes", 6).cast("double").alias("votes"))


def _long(spark, sf_dir):
    return candidates(table(spark, sf_dir, "dedup_report"), table(spark, sf_dir, "notion_sources"))


def p4_found(spark, sf_dir):
    return survivors(_long(spark, sf_dir)).select("group_id", "field", "row_id")


def p4_records(spark, sf_dir):
    """One surviving record per group, its fields pivoted back; null where no member is usable."""
    won = survivors(_long(spark, sf_dir)).groupBy("group_id").pivot("field", FIELDS).agg(F.first("value"))
    return table(spark, sf_dir, "dedup_report").groupBy("group_id").agg(F.countDistinct("row_id").alias("members")).join(won, "group_id", "left")


def p4_consensus(spark, sf_dir):
    return consensus_values(_long(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_records": p4_records, "p4_consensus": p4_consensus}
SQL: dict[str, str] = {}
