"""Secrets in texts, native: DataFrame functions only, no Python on the executors.

A span's offset is the summed length of what precedes it: the pieces between matches and the matches themselves.
Ownership frequency decides about a candidate value: it is counted by distinct repositories (files) and owners over the
whole corpus.  A value of several owners, or of many of one owner's repositories, is a widely copied example; another
varied value looks live, and bare copies of it without a telling prefix are added as spans.  Copies of a text count as one
repository, and equal surroundings of a value under several owners as one owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.session import written

KINDS = ("assign", "access", "hex")
_PATTERNS = {
    "assign": r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"(AKIA[A-Z0-9]+)",
    "hex": r"([0-9a-f]+)",
}
_LEAST = {"assign": 6, "access": 20, "hex": 24}
# Rows without a possible match are passed over; for hex only long runs are asked for, which changes no kept span.
_HINT = {"assign": _PATTERNS["assign"], "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
_SCAN = {**_PATTERNS, "hex": r"([0-9a-f]{24,})"}
_BARE = r"([A-Za-z0-9+/_.=-]{16,})"
_BARE_HINT = r"[A-Za-z0-9+/_.=-]{16}"
_PART = r"([^=/.]+)"  # bare runs hold names and paths beside a value
_SPAN = "array<struct<start:long,k:int,kind:string,end:long,value:string>>"
WIDE_OWNERS = 2  # a value of so many owners is an example
WIDE_REPOS, WIDE_SHARE = 8, 0.001  # as is one in more of an owner's repositories than both of these
AROUND = 40  # characters on each side of a match that are its surroundings
LIVE_LENGTH, LIVE_LETTERS = 16, 8  # a live-looking value has so many characters, so many different ones, and a digit


def matches(text: Column, pattern: str, k: int, kind: str, least: int) -> Column:
    """Leftmost non-overlapping matches whose first group has ``least`` characters, with code point offsets."""
    p = F.lit(pattern)
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("all"), F.regexp_extract_all(text, p, F.lit(1)).alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["all"]), F.lit(0))
        span = F.struct(start.cast("long").alias("start"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), end.cast("long").alias("end"), x["value"].alias("value"))
        keep = F.coalesce(F.length(x["value"]) >= least, F.lit(False))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).cast(_SPAN).alias("out"))

    return F.aggregate(both, F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")), step, lambda acc: acc["out"])


def _none() -> Column:
    return F.array().cast(_SPAN)


def base_spans(text: Column) -> Column:
    parts = [F.when(text.rlike(_HINT[k]), matches(text, _SCAN[k], i, k, _LEAST[k])).otherwise(_none()) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*parts))


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """(key, base, added, n_live, n_example): spans as arrays of (start, k, kind, end, value), start first.

    ``n_live`` and ``n_example`` count the base spans by the verdict on their value.  Null and empty texts have no spans.
    A null repository or owner counts as one of its own.  Repeated rows are returned as often as they occur; other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"), body.alias("body"))
    found = rows.select("key", F.xxhash64("body", "repo", "owner").alias("th"), F.xxhash64("body").alias("copy"), "repo", "owner", "body", base_spans(F.col("body")).alias("base"),
                        F.when(F.col("body").rlike(_BARE_HINT), matches(F.col("body"), _BARE, 9, "bare", 16)).otherwise(_none()).alias("bare"))
    around = F.transform("base", lambda s: F.xxhash64(
        F.substring(F.col("body"), F.greatest(s["start"] - AROUND, F.lit(0)).cast("int") + 1, F.least(s["start"], F.lit(AROUND)).cast("int")),
        F.substring(F.col("body"), s["end"].cast("int") + 1, F.lit(AROUND))))
    alone = F.filter("bare", lambda s: s["value"].rlike("[0-9]") & ~F.exists("base", lambda x: (x["start"] <= s["start"]) & (s["end"] <= x["end"])))
    rows = written(found.select("key", "th", "copy", "repo", "owner", "base", around.alias("around"), alone.alias("bare")), "secret-spans")

    plain = lambda v: F.regexp_replace(v, r"\.+$", "")  # noqa: E731  # full stops end a sentence
    values = rows.where(F.size("base") > 0).select("key", "th", "copy", "repo", "owner", F.explode(F.arrays_zip("base", "around")).alias("b")).select(
        "key", "th", "copy", "repo", "owner", F.col("b.base").alias("s"), F.col("b.around").alias("around"), plain(F.col("b.base.value")).alias("value"))
    # What has no owner is not known to be a copy.
    own = lambda c: F.when(F.col("owner").isNull(), F.concat(F.lit("-"), F.coalesce("repo", F.lit("")))).otherwise(F.col(c).cast("string"))
    owned = values.select(F.sha2("value", 256).alias("h"), F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("owner", F.lit("")).alias("owner"), own("copy").alias("copy"),
                          own("around").alias("around"), F.col("s.kind").alias("kind"), "value")
    by_copy = owned.groupBy("h", "owner", "copy").agg(F.min("repo").alias("repo"))
    sizes = rows.select(F.coalesce("owner", F.lit("")).alias("owner"), own("copy").alias("copy"), F.coalesce("repo", F.lit("")).alias("repo")).groupBy("owner", "copy").agg(
        F.min("repo").alias("repo")).select("owner", "repo").distinct().groupBy("owner").agg(F.count("*").alias("size"))
    repos = by_copy.select("h", "owner", "repo").distinct().groupBy("h", "owner").agg(F.count("*").alias("repos")).join(sizes, "owner").groupBy("h").agg(
        F.sum("repos").alias("repos"), F.max(F.col("repos") > F.greatest(F.lit(float(WIDE_REPOS)), WIDE_SHARE * F.col("size"))).alias("wide"))
    owners = owned.groupBy("h", "around").agg(F.min("owner").alias("owner")).select("h", "owner").distinct().groupBy("h").agg(F.count("*").alias("owners"))
    order = F.array(*map(F.lit, KINDS))
    named = owned.groupBy("h").agg(F.min("value").alias("value"), F.min_by("kind", F.array_position(order, F.col("kind"))).alias("kind"))
    letters = F.size(F.array_distinct(F.split("value", "")))
    varied = (F.length("value") >= LIVE_LENGTH) & (letters >= LIVE_LETTERS) & F.col("value").rlike("[0-9]")
    example = (F.col("owners") >= WIDE_OWNERS) | F.col("wide")
    stats = written(named.join(owners, "h").join(repos, "h").select("h", "owners", "repos", "kind", "value", example.alias("example"), (~example & varied).alias("live")), "secret-owners")

    judged = values.select("key", "th", F.sha2("value", 256).alias("h"), F.col("s.start").alias("start"), F.col("s.k").alias("k")).distinct().join(stats, "h")
    verdicts = judged.groupBy("key", "th").agg(F.sum(F.col("live").cast("long")).alias("n_live"), F.sum(F.col("example").cast("long")).alias("n_example"))
    # Bare copies of live values keep the kind under which the value was found.  They meet by the value's longest part.
    number = F.array_position(order, F.col("kind")).cast("int") - 1
    longest = F.array_max(F.transform(matches(F.col("value"), _PART, 9, "part", 1), lambda x: F.struct(F.length(x["value"]).alias("n"), (-x["start"]).alias("before"), x["value"].alias("part"))))
    live = stats.where("live").select("kind", "value", longest.alias("x")).select("kind", "value", F.col("x.part").alias("part"), (-F.col("x.before")).alias("before"))
    runs = rows.where(F.size("bare") > 0).select("key", "th", "base", F.explode("bare").alias("s"))
    parts = runs.select("key", "th", "base", "s", F.explode(matches(F.col("s.value"), _PART, 9, "part", 1)).alias("p")).select("key", "th", "base", "s", F.col("p.start").alias("p"), F.col("p.value").alias("part"))
    at, n = F.col("p") - F.col("before"), F.length("value")
    edge = lambda c: (c == "") | c.isin("=", "/", ".")
    char = lambda c: F.when(c < 0, F.lit("")).otherwise(F.substring(F.col("s.value"), c.cast("int") + 1, F.lit(1)))
    same_value = (at >= 0) & (F.substring(F.col("s.value"), at.cast("int") + 1, n) == F.col("value")) & edge(char(at - 1)) & edge(char(at + n))
    bare = parts.join(live, "part").where(same_value).select("key", "th", "base", "kind", F.struct((F.col("s.start") + at).alias("start"), (F.col("s.start") + at + n).alias("end"), F.col("value").alias("value")).alias("s")).where(
        ~F.exists("base", lambda x: (x["start"] < F.col("s.end")) & (F.col("s.start") < x["end"]))).drop("base").distinct()
    added = bare.groupBy("key", "th").agg(F.array_sort(F.collect_list(F.struct(
        F.col("s.start").alias("start"), number.alias("k"), F.col("kind").alias("kind"), F.col("s.end").alias("end"), F.col("s.value").alias("value")))).alias("added"))
    verdicts, added = (d.withColumnsRenamed({"key": f"{p}key", "th": f"{p}th"}) for d, p in ((verdicts, "v_"), (added, "a_")))
    same = lambda p: F.col("key").eqNullSafe(F.col(f"{p}key")) & (F.col("th") == F.col(f"{p}th"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(verdicts, same("v_"), "left").join(added, same("a_"), "left").select(
        F.col("key").alias(key), "base", F.coalesce("added", _none()).alias("added"), zero("n_live"), zero("n_example"))


def digest_text(found: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.concat_ws(",", F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
