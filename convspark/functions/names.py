"""Name, URL and host helpers (P13-P15) as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convspark.functions.text import col_of, py_strip

# Characters JavaScript's String.prototype.trim() removes
# (WhiteSpace + LineTerminator), as a regex class accepted by Java and RE2.
JS_WS_CLASS = (
    r"[\t\n\x{0b}\x{0c}\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}\x{feff}]"
)
# Fixed value: runs of characters outside this set become a single '-'.
UNSAFE_RUN = r"[^A-Za-z0-9._-]+"


def js_trim(c) -> Column:
    return F.regexp_replace(col_of(c), r"\A" + JS_WS_CLASS + r"+|" + JS_WS_CLASS + r"+\z", "")


def sanitize_name(c, prefix: str = "snapshot", clock: Column | int = 0) -> Column:
    """P13 (server flavour): strip, unsafe runs -> '-', trim '-' and '.' at
    both ends; an empty result becomes ``{prefix}_{clock}``."""
    fallback = F.concat(F.lit(prefix + "_"), (clock if isinstance(clock, Column) else F.lit(clock)).cast("string"))
    seed = F.coalesce(F.nullif(py_strip(F.coalesce(col_of(c), F.lit(""))), F.lit("")), fallback)
    cleaned = F.btrim(F.regexp_replace(seed, UNSAFE_RUN, "-"), F.lit("-."))
    return F.coalesce(F.nullif(cleaned, F.lit("")), fallback)


def sanitize_request_id(c) -> Column:
    """P13 (request-id flavour): no outer strip; empty => a uuid-shaped id
    derived from the raw id's hash, so a retried job reproduces it."""
    raw = F.coalesce(col_of(c).cast("string"), F.lit("None"))
    cleaned = F.btrim(F.regexp_replace(raw, UNSAFE_RUN, "-"), F.lit("-."))
    h = F.md5(raw)
    uuid_like = F.concat_ws("-", F.substr(h, F.lit(1), F.lit(8)), F.substr(h, F.lit(9), F.lit(4)),
                            F.substr(h, F.lit(13), F.lit(4)), F.substr(h, F.lit(17), F.lit(4)),
                            F.substr(h, F.lit(21), F.lit(12)))
    return F.coalesce(F.nullif(cleaned, F.lit("")), uuid_like)


def sanitize_dir_name_js(c) -> Column:
    """P13 (browser flavour): trim; blank => ''; unsafe runs -> '-', strip
    leading/trailing '-' only; empty => 'model'."""
    raw = js_trim(F.coalesce(col_of(c), F.lit("")))
    cleaned = F.regexp_replace(F.regexp_replace(raw, UNSAFE_RUN, "-"), r"^-+|-+$", "")
    return F.when(raw == "", F.lit("")).otherwise(F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("model")))


_URL_HEAD = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*"


def repo_model_name(c) -> Column:
    """Last non-empty path segment of a URL (query and fragment ignored);
    for anything that is not a URL, the last non-empty '/' segment."""
    s = js_trim(F.coalesce(col_of(c), F.lit("")))
    is_url = F.regexp_like(s, F.lit(_URL_HEAD))
    path = F.when(is_url, F.regexp_extract(s, _URL_HEAD + r"([^?#]*)", 1)).otherwise(s)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def normalize_host(c) -> Column:
    """Trim, default scheme ``ws://``, path reset to '/', trailing '/'
    dropped; null when no host can be read.  Host is lower-cased and the
    scheme's default port dropped, as a URL parser does."""
    v = js_trim(F.coalesce(col_of(c), F.lit("")))
    with_proto = F.when(F.startswith(v, F.lit("ws://")) | F.startswith(v, F.lit("wss://")), v) \
        .otherwise(F.concat(F.lit("ws://"), v))
    m = r"^(wss?)://([^/?#\s]*)([^?#]*)(\?[^#]*)?(#.*)?$"
    scheme = F.regexp_extract(with_proto, m, 1)
    auth = F.regexp_extract(with_proto, m, 2)
    user = F.regexp_replace(F.regexp_extract(auth, r"^(.*)@[^@]*$", 1), ":$", "")
    hostport = F.regexp_extract(auth, r"([^@]*)$", 1)
    hp_re = r"^(\[[^\]]*\]|[^:]*)(?::(.*))?$"  # a bracketed host holds colons of its own
    host = F.lower(F.regexp_extract(hostport, hp_re, 1))
    port = F.coalesce(F.regexp_extract(hostport, hp_re, 2), F.lit(""))
    default_port = F.when(scheme == "ws", F.lit("80")).otherwise(F.lit("443"))
    port_ok = (port == "") | (F.regexp_like(port, F.lit(r"^[0-9]+$"))
                              & F.coalesce(port.try_cast("long") <= 65535, F.lit(False)))
    port_norm = F.when(port == "", F.lit("")).otherwise(F.regexp_replace(port, "^0+(?=.)", ""))
    hp = F.when((port_norm == "") | (port_norm == default_port), host) \
        .otherwise(F.concat(host, F.lit(":"), port_norm))
    query = F.regexp_extract(with_proto, m, 4)
    frag = F.regexp_extract(with_proto, m, 5)
    rendered = F.concat(scheme, F.lit("://"), F.when(user == "", F.lit("")).otherwise(F.concat(user, F.lit("@"))), hp, F.lit("/"), query, frag)
    ok = (v != "") & F.regexp_like(with_proto, F.lit(m)) & (host != "") & port_ok \
        & F.regexp_like(host, F.lit(r"^[a-z0-9.\-_~%\[\]:]+$"))
    return F.when(ok, F.regexp_replace(rendered, "/$", ""))


def display_host(uri: Column) -> Column:
    """P15 display form: the URL's host[:port]."""
    return F.regexp_extract(uri, r"^wss?://([^/?#]*)", 1)
