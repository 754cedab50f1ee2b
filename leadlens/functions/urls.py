"""URLs: host, publisher, canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Second-level labels under which a third one names the publisher.
SECOND_LEVEL = ["co", "com", "org", "net", "gov", "ac", "edu"]
#: Fixed value: query parameters that only track.
TRACKING = r"(?i)^(utm_|fbclid|gclid|mc_|ref=|ref$|from=|from$)"


def host(c: Column) -> Column:
    """Lower-case host without "www."; null if the URL can't be read."""
    return F.regexp_replace(F.lower(F.try_parse_url(c, F.lit("HOST"))), r"^www\.", "")


def publisher(c: Column) -> Column:
    """The last two labels of the host, three under a common second level; "unknown" without a host."""
    parts = F.split(host(c), r"\.")
    tail = F.array_join(F.slice(parts, -2, 2), ".")
    deep = F.get(parts, F.size(parts) - 2).isin(*SECOND_LEVEL)
    name = F.when(F.size(parts) <= 2, F.array_join(parts, ".")).when(deep, F.array_join(F.slice(parts, -3, 3), ".")).otherwise(tail)
    return F.coalesce(name, F.lit("unknown"))


def canonical(c: Column) -> Column:
    """Without fragment, tracking parameters, "www." and the path's last slash; other parameters keep their order."""
    get = lambda part: F.try_parse_url(c, F.lit(part))
    kept = F.array_join(F.filter(F.split(F.coalesce(get("QUERY"), F.lit("")), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    path = F.coalesce(F.when(get("PATH") == "", "/").otherwise(get("PATH")), F.lit("/"))
    query = F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")
    trimmed = F.when((path != "/") & (kept == ""), F.regexp_replace(path, "/$", "")).otherwise(path)
    return F.when(host(c).isNotNull(), F.concat(F.lower(get("PROTOCOL")), F.lit("://"), host(c), trimmed, query)).otherwise(F.trim(c))
