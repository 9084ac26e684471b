"""What pages, certificates and other outside facts come through: functions called on workers, results as structs in columns.

A connector is a plain function of one value, made by a factory once for each partition (a session, say); any function can stand
in for it, as tests do. Values are asked once each: the distinct ones are probed and joined back.
"""

from __future__ import annotations

import datetime
import socket
import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = "status int, final_url string, headers map<string,string>, html string, error string, warning string"
CERTIFICATE = "valid boolean, issuer string, days_left int, protocol string, error string"
#: Answers that are asked for again, how often and with which first pause (fixed values).
AGAIN, TRIES, PAUSE = (500, 502, 503, 504), 3, 0.5


def probe(df: DataFrame, column: str, factory: Callable[[], Callable[[str], dict]], schema: str, into: str, spread: int | None = None) -> DataFrame:
    """Adds the struct that the function gives for a column's value; null values get null. Errors are the function's to report in its
    struct: one value's failure fails no task. ``spread``: over how many tasks the distinct values go."""
    kind = df.schema[column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = factory()
        for batch in batches:
            got = pd.DataFrame([ask(v) for v in batch["_value"]])
            got.insert(0, "_value", batch["_value"].to_numpy())
            yield got

    values = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("_value")).distinct()
    values = values.repartition(spread) if spread else values
    fields = [c.strip().split(" ")[0] for c in _split(schema)]
    found = values.mapInPandas(run, f"_value {kind}, {schema}").select("_value", F.struct(*fields).alias(into))
    return df.join(found, df[column] == found["_value"], "left").drop("_value")


def _split(schema: str) -> list[str]:
    """The fields of a schema text, commas within brackets left alone."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def variants(url: str) -> list[str]:
    """The address, with www flipped, and with the other scheme."""
    scheme, rest = (url.split("://", 1) + [""])[:2]
    flipped = rest[4:] if rest.lower().startswith("www.") else f"www.{rest}"
    return list(dict.fromkeys([url, f"{scheme}://{flipped}", f"{'http' if scheme.lower() == 'https' else 'https'}://{rest}"]))


def fetch_pages(timeout: float = 12.0, headers: dict[str, str] | None = None, pause: float = PAUSE) -> Callable[[], Callable[[str], dict]]:
    """A factory of page fetchers: answers of a broken server are asked for again with growing pauses, addresses that can't be
    reached are tried in their variants, with a warning."""

    def once(url: str) -> dict:
        for n in range(TRIES + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {"User-Agent": "Mozilla/5.0"}), timeout=timeout) as r:
                    return {"status": r.status, "final_url": r.url, "headers": dict(r.headers), "html": r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), "error": None, "warning": None}
            except urllib.error.HTTPError as e:
                if e.code not in AGAIN or n == TRIES:
                    return {"status": e.code, "final_url": e.url, "headers": dict(e.headers), "html": e.read().decode("utf-8", "replace"), "error": f"HTTP {e.code}", "warning": None}
                time.sleep(pause * 2**n)
        raise AssertionError

    def factory() -> Callable[[str], dict]:
        def ask(url: str) -> dict:
            said = None
            for k, u in enumerate(variants(url)):
                try:
                    return once(u) | ({"warning": f"reached as {u}"} if k else {})
                except (OSError, ValueError) as e:
                    said = said or str(e)
            return {"status": None, "final_url": None, "headers": None, "html": None, "error": said, "warning": None}

        return ask

    return factory


def certificates(timeout: float = 12.0) -> Callable[[], Callable[[str], dict]]:
    """A factory of probes of a host's certificate: valid if it has days left."""

    def ask(host: str) -> dict:
        try:
            name, _, port = host.partition(":")
            with socket.create_connection((name, int(port or 443)), timeout) as plain, ssl.create_default_context().wrap_socket(plain, server_hostname=name) as s:
                found = s.getpeercert()
                until = datetime.datetime.fromtimestamp(ssl.cert_time_to_seconds(found["notAfter"]), datetime.UTC)
                left = (until - datetime.datetime.now(datetime.UTC)).days
                issuer = dict(x[0] for x in found.get("issuer", ())).get("organizationName")
                return {"valid": left > 0, "issuer": issuer, "days_left": left, "protocol": s.version(), "error": None}
        except (OSError, ValueError) as e:
            return {"valid": False, "issuer": None, "days_left": None, "protocol": None, "error": str(e)}

    return lambda: ask


def site_files(timeout: float = 12.0) -> Callable[[], Callable[[str], dict]]:
    """A factory of probes of a site's robots file, sitemap (that the robots file names, else /sitemap.xml), icon, and whether plain
    http is sent on to https (null where that can't be told)."""
    import re

    def get(url: str) -> tuple[int | None, str, str]:
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:
                return r.status, r.read().decode("utf-8", "replace"), r.url
        except urllib.error.HTTPError as e:
            return e.code, "", url
        except (OSError, ValueError):
            return None, "", url

    def ask(url: str) -> dict:
        base = "{0.scheme}://{0.netloc}".format(urlsplit(url))
        status, robots, _ = get(f"{base}/robots.txt")
        named = re.search(r"(?im)^sitemap:\s*(\S+)", robots)
        sitemap = get(named[1] if named else f"{base}/sitemap.xml")[0] == 200
        icon = get(f"{base}/favicon.ico")
        plain = get("http://" + url.split("://", 1)[1]) if url.startswith("https://") else (None, "", "")
        return {"robots": status == 200, "sitemap": sitemap, "favicon": icon[0] == 200 and bool(icon[1]), "redirects": plain[2].startswith("https://") if plain[0] else None}

    return lambda: ask


SITE = "robots boolean, sitemap boolean, favicon boolean, redirects boolean"


def mail_hosts(resolve: Callable[[str], bool | None]) -> Callable[[], Callable[[str], dict]]:
    """A factory of probes whether a domain takes mail, by a resolver given (True, False, or None for unknown)."""
    return lambda: lambda domain: {"takes_mail": resolve(domain)}


def deliverable(df: DataFrame, email: str, resolve: Callable[[str], bool | None], into: str) -> DataFrame:
    """invalid_format, mx_ok, no_mx or mx_unknown of an address; each domain is asked once."""
    from leadloom.functions.contact import is_valid_email

    domain = F.when(is_valid_email(F.col(email)), F.lower(F.substring_index(email, "@", -1)))
    got = probe(df.withColumn("_domain", domain), "_domain", mail_hosts(resolve), "takes_mail boolean", "_mx")
    said = F.when(F.col("_domain").isNull(), "invalid_format").when(F.col("_mx.takes_mail"), "mx_ok").when(~F.col("_mx.takes_mail"), "no_mx").otherwise("mx_unknown")
    return got.withColumn(into, said).drop("_domain", "_mx")
