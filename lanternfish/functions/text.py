"""Text, URL and identity functions: Column -> Column, in built-ins; Python only where no built-in has the semantics."""

from __future__ import annotations

import html
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Namespaces of the point ids and of the checkpoint ids.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def clean_text(x: Column) -> Column:
    """Tags become spaces, runs of white space one space; null becomes ''."""
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"(?U)\s+", " ")), F.lit(""))


def strip_tags(x: Column) -> Column:
    """Tags vanish, inner white space stays; null becomes ''."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", ""), r"(?U)^\s+|\s+$", ""), F.lit(""))


@F.pandas_udf(StringType())
def unescaped(x: pd.Series) -> pd.Series:
    """Character references resolved; the table of names has no built-in."""
    return x.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def plain_text(x: Column) -> Column:
    """Tags become spaces, character references characters, runs of white space one space."""
    return F.trim(F.regexp_replace(unescaped(F.coalesce(F.regexp_replace(x, "<[^>]*>", " "), F.lit(""))), r"(?U)\s+", " "))


def canonical_query(x: Column) -> Column:
    """Lower case without ASCII punctuation (a hyphen is removed, not spaced), runs of white space one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(x, F.lit(""))), PUNCTUATION, ""), r"\s+", " "))


# The last part of a file's name, and the forms in which catalogues number the members of a series: number, numeral, page, number sign.
IMAGE_FILE = r"\.(?:jpg|jpeg|png|tif|tiff|webp|gif)$"
MEMBER_NUMBER = {"number": r"\(?[0-9]+\)?", "numeral": "[ivxlc]+", "short page": r"pp?\.?\s*[0-9]+", "page": r"page\s*[0-9]+", "number sign": r"no\.?\s*[0-9]+"}
SERIES_END = r"[\s\p{Z}_\-–—]*(?:" + "|".join(MEMBER_NUMBER.values()) + r")[\s\p{Z}]*$"


def series_stem(title: Column) -> Column:
    """Title without extension and a trailing number, lower case: equal for the members of a series."""
    base = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), f"(?i){IMAGE_FILE}", ""), f"(?i){SERIES_END}", "")
    return F.lower(F.trim(F.regexp_replace(base, r"[\s\p{Z}]+", " ")))


def words(x: Column) -> Column:
    """Tokens of the lexical index: runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def mentions(x: Column, terms: list[str]) -> Column:
    """Any of the terms as a whole word, whatever its case."""
    return x.rlike(r"(?i)\b(?:" + "|".join(terms) + r")\b")


def search_text(*parts: Column, limit: int = 1400) -> Column:
    """The non-blank parts, cleaned and joined."""
    cleaned = [F.when(clean_text(p) != "", clean_text(p)) for p in parts]
    return F.substring(F.concat_ws(" ", *cleaned), 1, limit)


def license_class(x: Column) -> Column:
    """public_domain, share_alike or, by default, attribution."""
    low = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"^\s+|\s+$", "")
    share = F.array_contains(F.split(F.replace(low, F.lit("-"), F.lit(" ")), r"\s+"), "sa") | low.contains("share")
    return F.when(low.rlike("cc0|public domain|pdm") | (low == "pd"), "public_domain").when(share, "share_alike").otherwise("attribution")


def clean_url(x: Column) -> Column:
    return F.regexp_replace(x, r"[?#].*$", "")


def url_host(x: Column) -> Column:
    """Host with its port, lower case; 'unknown' if there is none."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("")), F.lit("unknown"))


def secure_url(x: Column) -> Column:
    """The URL if it is https, has a host and names no user; else ''."""
    good = x.rlike(r"^https://[^/?#@:]+(:[0-9]+)?([/?#]|$)")
    return F.when(good, x).otherwise("")


def thumbnail_path(url: Column, width: int = 800) -> Column:
    """An original's URL of the form …/o/<name> to its thumbnail …/t/<name without extension>/<width>px.<extension>; other URLs stay."""
    return F.when(url.rlike(r"/o/[^/?#]+\.[A-Za-z]+"), F.regexp_replace(clean_url(url), r"/o/([^/]+)\.([A-Za-z]+)$", f"/t/$1/{width}px.$2")).otherwise(url)


def wider_rendition(thumb: Column, original_width: Column, width: int = 3840) -> Column:
    """The thumbnail URL with its width token replaced, where the original is wider; stills of moving or vector formats are left out."""
    fits = (original_width > width) & ~F.lower(clean_url(thumb)).rlike(r"\.(gif|svg|svg\.png)$") & thumb.rlike(r"/[^/]*[0-9]+px[^/]*$")
    return F.when(fits, F.regexp_replace(clean_url(thumb), r"[0-9]+px([^/]*)$", f"{width}px$1")).otherwise("")


def swapped_width(thumb: Column, hosts: tuple[str, ...], width: int = 3840) -> Column:
    """A thumbnail's URL with another width: the first width token of the last step of its path, without query; '' if the host is no thumbnail host, the path isn't one of thumbnails, there is no token, or
    the original moves or is drawn by vectors."""
    path = F.coalesce(F.parse_url(thumb, F.lit("PATH")), F.lit(""))
    name, folder = F.regexp_extract(path, r"([^/]*)$", 1), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    fits = _on(thumb, hosts) & F.contains(path, F.lit("/thumb/")) & ~F.lower(path).rlike(STILL) & name.rlike("[0-9]+px-")
    new = F.concat(F.regexp_extract(thumb, "^(https?)://", 1), F.lit("://"), F.regexp_extract(thumb, "^https?://([^/?#]*)", 1), folder, F.lit("/"), F.regexp_replace(name, "^(.*?)[0-9]+px-", f"$1{width}px-"))
    return F.coalesce(F.when(fits, new), F.lit(""))


#: Ends of names of which a rendition would only be a still.
STILL = r"\.(?:gif|svg|svg\.png)$"


def _on(url: Column, hosts: tuple[str, ...]) -> Column:
    return F.lower(F.regexp_extract(url, "^https?://([^/?#]*)", 1)).isin(*hosts)


def thumbnail_of_original(url: Column, host: str, marker: str, width: int = 3840) -> Column:
    """The thumbnail's URL that belongs to an original under ``marker``: the path below it, under thumb/, with a last step of the width and the name; '' if the original lies elsewhere or is no still."""
    path = F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit(""))
    below, name = F.regexp_replace(path, f"^{marker}", ""), F.regexp_extract(path, r"([^/]*)$", 1)
    fits = _on(url, (host,)) & path.startswith(marker) & ~F.contains(path, F.lit("/thumb/")) & (name != "") & ~F.lower(name).rlike(STILL)
    new = F.concat(F.regexp_extract(url, "^(https?)://", 1), F.lit("://"), F.regexp_extract(url, "^https?://([^/?#]*)", 1), F.lit(f"{marker}thumb/"), below, F.lit(f"/{width}px-"), name)
    return F.coalesce(F.when(fits, new), F.lit(""))


def rendition(width: Column, thumb: Column, original: Column, hosts: tuple[str, ...], host: str, marker: str, wanted: int = 3840) -> Column:
    """The wider rendition of an original that is wider than it: from its thumbnail's URL, else from its own; '' stands for the original."""
    swapped = swapped_width(thumb, hosts, wanted)
    wide = F.coalesce(width.try_cast("int"), F.lit(0)) > wanted
    return F.when(wide, F.when(swapped != "", swapped).otherwise(thumbnail_of_original(original, host, marker, wanted))).otherwise("")


def shown_thumbnail(cdn: Column, origin: Column, base: str = "") -> Column:
    """Where a thumbnail is loaded from: an object of the own store (a key without scheme, under ``base``), else the source's own, else an old proxy's URL."""
    own, other = F.coalesce(cdn, F.lit("")), F.coalesce(origin, F.lit(""))
    return F.when((own != "") & ~own.startswith("http"), F.concat(F.lit(base), own)).when(other != "", other).otherwise(own)


def stored_url(key: Column, mode: str, base: str = "", width: int = 384) -> Column:
    """The address of an object in one of three modes: ``key`` (the bare key, signed on the way out), ``public`` (under a base) and ``proxy`` (the original through a resizing proxy)."""
    if mode == "proxy":
        return F.concat(F.lit(f"{base}?w={width}&url="), percent_encoded(key))
    return F.concat(F.lit(base if mode == "public" else ""), key)


def derivative(url: Column, source: Column, landing: Column, site: str, domain: str) -> tuple[Column, Column]:
    """(asset key, thumbnail) of a provider's URL: on ``site`` under ``domain``, number and secret of the file's name give both; elsewhere the digest of the landing page is the key and the URL its own thumbnail."""
    host, path = F.lower(F.regexp_extract(url, "^https://([^/?#:]*)", 1)), F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit(""))
    named = r"^/(?:[^/]+/)*([0-9]+)_([a-zA-Z0-9]+)(?:_[a-zA-Z0-9]+)?\.(jpg|png)$"
    own = (source == site) & host.endswith(f".{domain}") & path.rlike(named)
    small = F.concat(F.lit("https://"), host, F.regexp_replace(path, r"([0-9]+)_([a-zA-Z0-9]+)(?:_[a-zA-Z0-9]+)?\.(jpg|png)$", "$1_$2_n.$3"))
    key = F.when(own, F.concat(F.lit(f"{site}:"), F.regexp_extract(path, named, 1))).otherwise(F.concat(source, F.lit(":"), F.sha2(landing, 256)))
    return key, F.when(own, small).otherwise(url)


def percent_encoded(x: Column) -> Column:
    """url_encode with %20 for a space."""
    return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))


def uuid5(x: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Name-based UUID of version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(x, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


@F.pandas_udf(StringType())
def canonical_json(x: pd.Series) -> pd.Series:
    """JSON with its keys in order, without blanks, in ASCII; text that is no JSON stays as it is."""

    def one(v: str) -> str:
        try:
            return json.dumps(json.loads(v), sort_keys=True, separators=(",", ":"))
        except ValueError:
            return v

    return x.map(one, na_action="ignore")


def unit_hash(build: Column, unit: Column) -> Column:
    """sha256 of the build and the unit's canonical JSON."""
    return F.sha2(F.concat(build, F.lit("|"), canonical_json(unit)), 256)


def object_key(image_id: Column) -> Column:
    """Key with a balanced two-level prefix, so that no prefix gets hot."""
    h = F.md5(F.replace(image_id, F.lit(":"), F.lit("_")))
    return F.concat(F.lit("t/"), F.substring(h, 1, 2), F.lit("/"), F.substring(h, 3, 2), F.lit("/"), F.replace(image_id, F.lit(":"), F.lit("_")), F.lit(".webp"))
