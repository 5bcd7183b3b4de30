"""Resolution of not-modified revisits in web captures: an as-of join by canonical URL.

A revisit says that a resource had not changed when it was fetched again; its body is that of the latest earlier full
response for the same canonical URL, if the validators of the two agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Headers that a not-modified answer may update (HTTP semantics), lower case.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Parameters of a query that don't name another resource, as a pattern.
IGNORED = r"^(utm_[^=]*|fbclid|gclid)(=.*)?$"
#: Headers that validate a body, the first that both records have decides.
VALIDATORS = ("etag", "last-modified", "warc-payload-digest")
#: Production parameter: units of time in a block. Captures of one URL are searched block by block.
BLOCK = 4096


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, user, leading www., default port, fragment, trailing slash or IGNORED parameters; the others sorted. Null stays null; text without a scheme is lower-cased and kept."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)\??(.*)$"
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, pattern, 2)), r"^[^@]*@", "")
    host = F.regexp_replace(F.concat(F.lower(F.regexp_extract(plain, pattern, 1)), F.lit("://"), host), r"^(http://.*):80$|^(https://.*):443$", "$1$2")
    host = F.regexp_replace(F.regexp_replace(host, "^[^:]*://", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(plain, pattern, 3), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(plain, pattern, 4), "&", -1), lambda x: (x != "") & ~F.rlike(x, F.lit(IGNORED)))), "&")
    return F.when(F.rlike(plain, F.lit(pattern)), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))).otherwise(F.lower(plain))


def _validator(headers: str, name: str) -> Column:
    """The value of a header; entity tags are compared weakly, that is without W/."""
    value = F.element_at(F.col(headers), name)
    return F.regexp_replace(value, "^W/", "") if name == "etag" else value


def resolve_revisits(records: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every record with its canonical URL and, for revisits, what they resolve to.

    records: record_id, kind ('response' is a full response, 'revisit' a not-modified answer, all others pass), url, at
    (a whole number that grows with time), headers (map of lower-case names). Returns record_id, kind, canonical, at, status, response_id,
    headers: for a revisit, status is 'resolved', 'changed' (of the VALIDATORS, the first that both records have differs),
    'unverified' (they have none in common) or 'missing' (no earlier response); a resolved one has the response's headers, with
    those PERMITTED replaced by its own. For any other record status and response_id are null. Of responses at one
    time the one with the greatest record_id counts, and "earlier" is strict. A null URL or time matches nothing; repeated
    rows each come back; an empty table gives an empty one; other columns are ignored.

    No URL's captures meet in one task: the latest response of each block of time is carried from block to block, and only
    the captures of one URL and block are sorted.
    """
    named = records.select("record_id", "kind", canonical_url(F.col("url")).alias("canonical"), "at", "headers")
    usable = F.col("canonical").isNotNull() & F.col("at").isNotNull()
    named = named.withColumn("_block", F.when(usable, F.floor(F.col("at") / block).cast("long")))
    timed = named.filter("_block IS NOT NULL")
    answer = F.struct("at", "record_id", "headers")
    latest = timed.filter("kind = 'response'").groupBy("canonical", "_block").agg(F.max_by(answer, F.struct("at", "record_id")).alias("r"))
    before = Window.partitionBy("canonical").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = timed.select("canonical", "_block").distinct().join(latest, ["canonical", "_block"], "left")
    carried = blocks.select("canonical", "_block", F.last("r", ignorenulls=True).over(before).alias("_carried"))
    within = Window.partitionBy("canonical", "_block").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    last = F.max_by(F.when(F.col("kind") == "response", answer), F.when(F.col("kind") == "response", F.struct("at", "record_id"))).over(within)
    found = timed.withColumn("_inside", last).join(carried, ["canonical", "_block"], "left").withColumn("_r", F.coalesce("_inside", "_carried"))
    whole = found.select("record_id", "kind", "canonical", "at", "headers", "_r").unionByName(named.filter("_block IS NULL").select("record_id", "kind", "canonical", "at", "headers"), allowMissingColumns=True)
    whole = whole.withColumn("_theirs", F.col("_r.headers"))
    same = F.coalesce(*(_validator("headers", v) == _validator("_theirs", v) for v in VALIDATORS))
    revisit = F.col("kind") == "revisit"
    status = F.when(revisit, F.when(F.col("_r").isNull(), "missing").when(same.isNull(), "unverified").when(same, "resolved").otherwise("changed"))
    permitted = lambda k: k.isin(*PERMITTED)
    own = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: permitted(k))
    theirs = F.map_filter(F.coalesce("_theirs", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(own), k))
    whole = whole.withColumn("status", status)
    resolved = F.col("status") == "resolved"
    return whole.select("record_id", "kind", "canonical", "at", "status", F.when(resolved, F.col("_r.record_id")).alias("response_id"), F.when(resolved, F.map_concat(theirs, own)).otherwise(F.col("headers")).alias("headers"))
