"""What response headers, statuses and URLs say."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from feedledger.functions.scalars import present

# Status lists and the one host lookups may go to.
LIMIT_STATUSES = (403, 429)
REDIRECT_STATUSES = (301, 302, 303, 307, 308)
GONE_STATUSES = (404, 410)
ALLOWED_HOST = "api.github.com"
ALLOWED_SCHEME = "https"
DEFAULT_PORT = "443"

_LINK = r'<([^>]*)>((?:\s*;\s*[^;,"]*(?:"[^"]*")?)*)'
_REL = r';\s*([^\s=;]+)\s*=\s*(?:"([^"]*)"|([^;,\s]*))'
_URI = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
_URI_CHARS = r"^(?:[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=]|%[0-9A-Fa-f]{2})*\z"


def header(headers: Column, name: str) -> Column:
    """A header by name in any letter case; the last one wins."""
    same = F.filter(F.map_entries(headers), lambda entry: F.lower(entry["key"]) == name)
    return F.try_element_at(same, F.lit(-1))["value"]


def next_link(value: Column) -> Column:
    """Target of the first link whose relations include ``next``."""
    targets = F.regexp_extract_all(value, F.lit(_LINK), F.lit(1))
    params = F.regexp_extract_all(value, F.lit(_LINK), F.lit(2))
    links = F.arrays_zip(targets.alias("target"), params.alias("params"))

    def leads_on(link: Column) -> Column:
        names = F.regexp_extract_all(link["params"], F.lit(_REL), F.lit(1))
        quoted = F.regexp_extract_all(link["params"], F.lit(_REL), F.lit(2))
        bare = F.regexp_extract_all(link["params"], F.lit(_REL), F.lit(3))
        values = F.arrays_zip(names.alias("name"), quoted.alias("quoted"), bare.alias("bare"))
        return F.exists(values, lambda p: (F.lower(p["name"]) == "rel") & F.array_contains(
            F.split(F.lower(F.concat(p["quoted"], p["bare"])), r"\s+"), "next"))

    found = F.filter(links, lambda link: (F.trim(link["target"]) != "") & leads_on(link))
    return F.try_element_at(found, F.lit(1))["target"]


def request_key(url: Column) -> Column:
    """Path and query with the pairs sorted, so one request has one spelling."""
    path = F.regexp_extract(url, _URI, 3)
    query = F.regexp_extract(url, _URI, 4)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(
        F.try_url_decode(F.substring_index(p, "=", 1)).alias("name"),
        F.coalesce(F.try_url_decode(F.regexp_extract(p, r"=(.*)\z", 1)), F.lit("")).alias("value")))
    encoded = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(
        F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&")
    return F.when(url.isNull(), None).when(query == "", path).otherwise(
        F.coalesce(F.concat(path, F.lit("?"), encoded), url))


def http_class(status: Column, headers: Column) -> Column:
    """Outcome class of an answer."""
    exhausted = F.coalesce(F.trim(header(headers, "x-ratelimit-remaining")) == "0", F.lit(False))
    return (
        F.when(status.between(200, 299), "ok")
        .when(status == 304, "not_modified")
        .when(status.isin(*REDIRECT_STATUSES),
              F.when(present(header(headers, "location")), "redirect").otherwise("client_error"))
        .when(status.isin(*LIMIT_STATUSES), F.when(exhausted, "rate_limited").otherwise("secondary_limited"))
        .when(status.isin(*GONE_STATUSES), "not_found")
        .when(status.between(400, 499), "client_error")
        .when(status >= 500, "server_error")
        .when(status.isNotNull(), "client_error")
    )


def _filled(value: Column) -> Column:
    trimmed = F.regexp_replace(value, r"^\s+|\s+\z", "")
    return F.when(trimmed != "", trimmed)


def _whole_number(value: Column) -> Column:
    text = _filled(value)
    return F.when(text.rlike(r"^[+-]?\d+(?:_\d+)*\z"),
                  F.regexp_replace(text, "_", "").try_cast("long"))


def _http_date(value: Column) -> Column:
    text = _filled(value)
    day = F.when(text.rlike(r"^[A-Za-z]{3}, \d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} GMT\z"),
                 F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3}, ", ""), " GMT$", ""))
    return F.try_to_timestamp(day, F.lit("dd MMM yyyy HH:mm:ss"))


def rate_limit_fields(headers: Column, observed_at: Column) -> Column:
    """Quota headers as one struct; whatever cannot be read is null."""
    retry_after = header(headers, "retry-after")
    until = F.unix_micros(_http_date(retry_after)) - F.unix_micros(observed_at)
    return F.struct(
        _filled(header(headers, "x-ratelimit-resource")).alias("resource"),
        _whole_number(header(headers, "x-ratelimit-limit")).alias("limit"),
        _whole_number(header(headers, "x-ratelimit-remaining")).alias("remaining"),
        _whole_number(header(headers, "x-ratelimit-used")).alias("used"),
        F.timestamp_seconds(_whole_number(header(headers, "x-ratelimit-reset"))).alias("reset_at"),
        _whole_number(header(headers, "x-poll-interval")).alias("poll_interval_seconds"),
        F.coalesce(_whole_number(retry_after), F.round(until / F.lit(1_000_000)).cast("long"))
        .alias("retry_after_seconds"),
        _filled(header(headers, "etag")).alias("etag"),
    )


def url_violations(url: Column) -> Column:
    """Every reason a lookup address would be refused, in check order; empty when allowed."""
    scheme, authority = F.regexp_extract(url, _URI, 1), F.regexp_extract(url, _URI, 2)
    userinfo = F.regexp_extract(authority, r"^(.*)@", 1)
    location = F.regexp_replace(authority, r"^.*@", "")
    host = F.regexp_extract(location, r"^(\[[^\]]*\]|[^:]*)", 1)
    port = F.regexp_extract(location, r"^(?:\[[^\]]*\]|[^:\[]*):(.*)\z", 1)
    octet = r"(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
    literal = host.startswith("[") | host.rlike(rf"^{octet}(?:\.{octet}){{3}}\z")
    legal = url.rlike(_URI_CHARS) & url.rlike(_URI) & port.rlike(r"^\d*\z") & \
        ~F.regexp_replace(host, r"^\[.*\]\z", "").rlike(r"[\[\]]")
    bad_scheme = F.lower(scheme) != ALLOWED_SCHEME

    def reason(name: str, test: Column) -> Column:
        return F.when(test, F.lit(name))

    empty = F.coalesce(F.trim(url) == "", F.lit(True))
    found = F.array_compact(F.array(
        reason("not_absolute", scheme == ""),
        reason("scheme_not_allowed", (scheme != "") & bad_scheme),
        reason("non_default_port", (scheme != "") & ~bad_scheme & (port != "") & (port != DEFAULT_PORT)),
        reason("userinfo_present", present(userinfo)),
        reason("host_missing", host == ""),
        reason("ip_literal_host", (host != "") & literal),
        reason("host_not_allowed", (host != "") & ~literal & (F.lower(host) != ALLOWED_HOST)),
    ))
    return (F.when(empty, F.array(F.lit("blank")))
            .when(~legal, F.array(F.lit("unparsable")))
            .otherwise(found))
