"""URL expressions: canonical form and the board a URL belongs to."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def strip(c: Column) -> Column:
    """Without white space (Unicode) at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def canonicalize_url(url: Column) -> Column:
    """Canonical form; what isn't scheme://host stays as it is but for white space at its ends, as does a URL whose port is no port."""
    full = strip(F.coalesce(url, F.lit("")))
    plain = F.regexp_replace(full, r"[\t\r\n]", "")
    part = lambda k: F.coalesce(F.regexp_extract(plain, PARTS, k), F.lit(""))
    scheme, netloc, path, query = F.lower(part(1)), part(2), part(3), part(4)
    user = F.regexp_extract(netloc, "^(.*@)", 1)
    host_port = F.substr(netloc, F.length(user) + 1)
    host = F.lower(F.regexp_extract(host_port, r"^\[([^\]]*)\]|^([^:]*)", 0))
    port = F.regexp_extract(host_port, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)
    number = F.regexp_replace(port, "^0+(?=.)", "").try_cast("int")
    bad = (port != "") & (~F.regexp_like(port, F.lit("^[0-9]+$")) | F.coalesce(number > 65535, F.lit(True)))
    shown = F.when((port == "") | (number == 0) | ((scheme == "http") & (number == 80)) | ((scheme == "https") & (number == 443)), "").otherwise(F.concat(F.lit(":"), number.cast("string")))
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).when(path == "", "/").otherwise(path)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.struct(_decoded(F.substring_index(x, "=", 1)).alias("name"), _decoded(F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)).alias("value")))
    tracking = lambda p: F.lower(p["name"]).startswith("utm_") | F.lower(p["name"]).isin(fixed.TRACKING)
    kept = F.array_sort(F.filter(pairs, lambda p: ~tracking(p)))
    text = F.array_join(F.transform(kept, lambda p: F.when(p["value"] == "", p["name"]).otherwise(F.concat_ws("=", p["name"], p["value"]))), "&")
    made = F.concat(scheme, F.lit("://"), user, host, shown, path, F.when(text == "", "").otherwise(F.concat(F.lit("?"), text)))
    return F.when((scheme == "") | (netloc == "") | bad, full).otherwise(made)


def board_name(url: Column) -> Column:
    """Board key of a posting URL, 'generic' for unknown ones."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    found = F.when(F.lit(False), "")
    for fragment, name in fixed.BOARD_HOSTS:
        found = found.when(F.contains(host, F.lit(fragment)), name)
    return found.when(F.regexp_like(F.coalesce(url, F.lit("")), F.lit(fixed.RADANCY_JOB)), "radancy").otherwise("generic")
