"""URL filters by a temporal list join.

A list is a table of dated entries: at a time a key (a host, with all hosts below it, or a host with the
start of a path) is put on the list or taken off it. Each key's entries become
validity intervals, and an as-of join evaluates every capture against the entries that are active when it
was fetched: the capture's keys, all suffixes of its host and all leading parts of its path, meet
the intervals by equality, and the interval must hold the time of the fetch. The most specific active
entry decides: a longer path before a shorter one, a longer host before a shorter one.

Defined cases: of entries of one key at one time the one that takes it off counts; an entry without a
key, time or action is ignored; an interval is closed at its start and open at its end. A URL that is null or
has no host meets no entry and is kept, and so is a capture without a time. Repeated captures get equal
results; empty tables give an empty result, or one in which all is kept. Hosts are compared in lower
case without port, user and dots at the end, as clients read them: blanks around a URL, backslashes for slashes, an @ in the user's
part, escaped characters of the host and dots in the path change nothing. Names in other scripts are compared as they are written, not by their
encoded form, and so are escapes in the path; a host of one label meets no entry. URLs of any length, with any
number of labels and path parts, are taken whole. Further columns of the captures are not looked at.

Equal pairs of URL and time are evaluated once, so a host with a third of all captures meets
the list by its distinct pairs, and a list is broadcast only if it has few entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intervals of a list that may be broadcast; longer lists are shuffled.
BROADCAST_ROWS = 100_000
#: The start of a URL up to its authority, as an expression.
SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*:[/\\]+"
#: A dot of a path, escaped or not, and the dots of names in other scripts.
DOT, WIDE_DOTS = r"(?:\.|%2[eE])", "\u3002\uff0e\uff61"


def lowered(key: Column) -> Column:
    """The key with its host in lower case and without dots at its end; its path stays."""
    key = F.regexp_replace(key, r"^([^/]*[^/.])\.+(?=/|$)", "$1")
    at = F.instr(key, "/")
    return F.when(at == 0, F.lower(key)).otherwise(F.concat(F.lower(F.substr(key, F.lit(1), at)), F.substr(key, at + 1)))


def intervals(entries: DataFrame) -> DataFrame:
    """key, category, allow, valid_from, valid_to (null: still active) from key, category, allow, listed, at."""
    rows = entries.where(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("listed").isNotNull())
    rows = rows.groupBy(lowered(F.col("key")).alias("key"), "at").agg(
        F.min_by(F.struct("listed", "category", "allow"), F.struct("listed", "category", "allow")).alias("e")
    )
    following = F.lead("at").over(Window.partitionBy("key").orderBy("at"))
    rows = rows.select("key", "e.*", F.col("at").alias("valid_from"), following.alias("valid_to"))
    return rows.where("listed").select("key", "category", F.coalesce("allow", F.lit(False)).alias("allow"), "valid_from", "valid_to")


def _plain(url: Column) -> Column:
    """A URL as clients read it: without control characters and blanks at its ends, without tabs and line breaks."""
    return F.regexp_replace(url, r"\A[\x00-\x20]+|[\x00-\x20]+\z|[\t\n\r]", "")


def host(url: Column) -> Column:
    """Lower-cased host without user, port and dots at its end (the root of names); empty if there is none.

    A backslash is a slash, the user ends at the last @, and escapes and the wide dots are what they stand for.
    """
    authority = F.regexp_extract(_plain(url), rf"^{SCHEME}([^/?#\\]*)", 1)
    found = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", "")
    found = F.when(F.contains(found, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(found, F.lit("+"), F.lit("%2B"))), found)).otherwise(found)
    return F.lower(F.rtrim(F.translate(found, WIDE_DOTS, "." * len(WIDE_DOTS)), F.lit(".")))


def path_parts(url: Column) -> Column:
    """Parts of the path without empty ones; a part of one dot goes, and one of two dots takes the part before it along."""
    path = F.translate(F.regexp_extract(_plain(url), rf"^{SCHEME}[^/?#\\]*([/\\][^?#]*)", 1), "\\", "/")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    dotted = F.rlike(path, F.lit(rf"(^|/)({DOT}){{1,2}}(/|$)"))
    start = F.array().cast("array<string>")

    def put(held, x):
        return (
            F.when(F.rlike(x, F.lit(rf"^{DOT}$")), held)
            .when(F.rlike(x, F.lit(rf"^{DOT}{DOT}$")), F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))))
            .otherwise(F.array_append(held, x))
        )

    return F.when(dotted, F.aggregate(parts, start, put)).otherwise(parts)


def depths(listed: DataFrame) -> tuple[int, int]:
    """The most host labels and the most path parts of any key."""
    labels = F.size(F.split(F.substring_index("key", "/", 1), r"\."))
    parts = F.size(F.split("key", "/")) - 1
    found = listed.agg(F.max(labels), F.max(parts)).first()
    return found[0] or 0, found[1] or 0


def match_keys(url: Column, most_labels: int, most_parts: int) -> Column:
    """Keys that could list the URL with their rank: host suffixes of two labels or more, each with leading path parts.

    Keys with more labels or parts than any listed key has are left out.
    """
    labels = F.split(host(url), r"\.")
    parts = F.slice(path_parts(url), 1, most_parts)
    first = F.greatest(F.lit(1), F.least(F.size(labels) - 1, F.size(labels) - (most_labels - 1)))
    suffixes = F.when(
        (F.size(labels) >= 2),
        F.transform(F.sequence(first, F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    paths = F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.struct(n.alias("depth"), F.when(n > 0, F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.lit("")).alias("path")),
    )
    return F.flatten(
        F.transform(
            suffixes,
            lambda s: F.transform(
                paths,
                lambda p: F.struct(F.concat(s, p["path"]).alias("key"), F.struct(p["depth"].alias("depth"), F.length(s).alias("length")).alias("rank")),
            ),
        )
    )


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", at_col: str = "fetched", keep: tuple = ()) -> DataFrame:
    """A row per capture: the columns of keep, url, time, n_active (entries that apply), entry (the deciding key), category, blocked."""
    listed = intervals(entries)
    few = listed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    names = [f"_k{i}" for i in range(len(keep))]
    rows = captures.select(
        *(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(url_col).alias("url"), F.col(at_col).alias("fetched")
    )
    asked = rows.where(F.col("url").isNotNull() & F.col("fetched").isNotNull()).select("url", "fetched").distinct()
    asked = asked.select("url", "fetched", F.explode(match_keys(F.col("url"), *depths(listed))).alias("k"))
    asked = asked.select("url", "fetched", "k.key", "k.rank")
    active = asked.join(F.broadcast(listed) if few else listed, "key").where(
        (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    )
    verdict = active.groupBy("url", "fetched").agg(
        F.count("*").alias("n_active"), F.max_by(F.struct("key", "category", "allow"), F.struct("rank", "key")).alias("first")
    )
    out = rows.join(verdict, ["url", "fetched"], "left")
    return out.select(
        *(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)),
        F.col("url").alias(url_col),
        F.col("fetched").alias(at_col),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.col("first.key").alias("entry"),
        F.col("first.category").alias("category"),
        (F.col("first").isNotNull() & ~F.coalesce(F.col("first.allow"), F.lit(False))).alias("blocked"),
    )
