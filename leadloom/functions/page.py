"""Facts of HTML pages: one tolerant parse per page in a struct-returning pandas UDF; all rules over them are native columns."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = (
    "title string, text string, h1_count int, img_total int, img_missing_alt int, structural_tags int, meta_description string, robots_meta string, has_viewport boolean, has_canonical boolean, "
    "og_title string, og_description string, og_image string, og_site_name string, icon_link boolean, hrefs array<string>, "
    "forms array<struct<role:string,action:string,input_types:array<string>,input_names:array<string>,n_textarea:int,n_fields:int>>, jsonld array<string>"
)
SILENT = {"script", "style", "template", "noscript"}
STRUCTURE = {"p", "h1", "h2", "h3", "form", "a", "li"}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.words: list[str] = []
        self.facts = {k: None for k in ("title", "meta_description", "robots_meta", "og_title", "og_description", "og_image", "og_site_name")}
        self.facts |= {"h1_count": 0, "img_total": 0, "img_missing_alt": 0, "structural_tags": 0, "has_viewport": False, "has_canonical": False, "icon_link": False, "hrefs": [], "forms": [], "jsonld": []}
        self.silent, self.in_title, self.data, self.form = [], False, None, None

    def handle_starttag(self, tag, attrs):
        a, f = {k: v or "" for k, v in attrs}, self.facts
        f["structural_tags"] += tag in STRUCTURE
        if tag in SILENT:
            self.silent.append(tag)
            if tag == "script" and a.get("type", "").lower().startswith("application/ld+json"):
                self.data = ""
        elif tag == "title":
            self.in_title = f["title"] is None
            f["title"] = f["title"] or ""
        elif tag == "h1":
            f["h1_count"] += 1
        elif tag == "img":
            f["img_total"] += 1
            f["img_missing_alt"] += not a.get("alt", "").strip()
        elif tag == "meta":
            name, content = (a.get("name") or a.get("property") or "").lower(), a.get("content", "")
            for key, field in (("description", "meta_description"), ("robots", "robots_meta"), ("og:title", "og_title"), ("og:description", "og_description"), ("og:image", "og_image"), ("og:site_name", "og_site_name")):
                if name == key and f[field] is None:
                    f[field] = content
            f["has_viewport"] |= name == "viewport"
        elif tag == "link":
            rel = a.get("rel", "").lower()
            f["has_canonical"] |= rel == "canonical"
            f["icon_link"] |= "icon" in rel
        elif tag == "a" and "href" in a:
            f["hrefs"].append(a["href"])
        elif tag == "form":
            self.form = {"role": a.get("role"), "action": a.get("action"), "input_types": [], "input_names": [], "n_textarea": 0, "n_fields": 0}
            f["forms"].append(self.form)
        elif tag in ("input", "textarea", "select") and self.form is not None:
            self.form["n_fields"] += 1
            self.form["n_textarea"] += tag == "textarea"
            if tag == "input":
                self.form["input_types"].append(a.get("type", "text").lower())
                self.form["input_names"].append(a.get("name", "").lower())

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag == "form":
            self.form = None
        elif self.silent and tag in SILENT:
            self.silent.pop()
            if self.data is not None:
                self.facts["jsonld"].append(self.data)
                self.data = None

    def handle_data(self, data):
        if self.data is not None:
            self.data += data
        elif self.in_title:
            self.facts["title"] += data
        if not self.silent and data.strip():
            self.words.append(data.strip())


def page(html: str | None) -> dict:
    """Facts of one page; an empty page's for null."""
    p = _Page()
    p.feed(html or "")
    p.close()
    p.facts["title"] = (p.facts["title"] or "").strip() or None
    return p.facts | {"text": " ".join(p.words)}


def _facts(html: pd.Series) -> pd.DataFrame:
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    return pd.DataFrame([page(h) for h in html], columns=names)


def page_facts(html: Column | str) -> Column:
    """The struct of a page's facts. Made on call, as a session must be there."""
    return F.pandas_udf(_facts, SCHEMA)(html)


def internal_links(hrefs: Column, host: Column) -> Column:
    """Links of the page's own host or relative ones, each once, without fragments, mail and phone links."""
    real = F.filter(hrefs, lambda h: ~h.rlike(r"(?i)^\s*(?:mailto:|tel:|javascript:|#|$)"))
    own = F.filter(real, lambda h: ~h.rlike("(?i)^(?:https?:)?//") | (F.regexp_replace(F.lower(F.regexp_extract(h, r"(?i)^(?:https?:)?//([^/?#]+)", 1)), r"^www\.", "") == F.regexp_replace(F.lower(host), r"^www\.", "")))
    return F.array_distinct(F.transform(own, lambda h: F.regexp_replace(h, "#.*$", "")))


def social_links(hrefs: Column, hosts: tuple[str, ...]) -> Column:
    """At most six links to the given hosts or hosts under them, each once, without queries and share widgets."""
    rx = r"(?i)^https?://(?:[^/]+\.)?(?:" + "|".join(h.replace(".", r"\.") for h in hosts) + r")(?:/|$)"
    kept = F.filter(hrefs, lambda h: h.rlike(rx) & ~h.rlike(r"(?i)/(?:share|sharer|intent)\b"))
    return F.slice(F.array_distinct(F.transform(kept, lambda h: F.regexp_replace(h, r"[?#].*$", ""))), 1, 6)


def is_search_form(form: Column) -> Column:
    return F.coalesce(form["role"] == "search", F.lit(False)) | F.coalesce(form["action"].rlike("(?i)search"), F.lit(False)) | F.exists(form["input_types"], lambda t: t == "search") | F.exists(form["input_names"], lambda n: n.isin("q", "s", "search", "query"))


def lead_forms(forms: Column) -> Column:
    """Forms that aren't for searching and have a text-like input or a text area."""
    real = lambda f: F.exists(f["input_types"], lambda t: ~t.isin("hidden", "submit", "button", "reset", "image", "checkbox", "radio", "search"))
    return F.filter(forms, lambda f: ~is_search_form(f) & (real(f) | (f["n_textarea"] > 0)))


def js_shell(html: Column, facts: Column) -> Column:
    """A long page with next to no text and structure, as scripts render them."""
    return (F.length(html) > 1500) & (F.length(facts["text"]) < 200) & (facts["structural_tags"] < 5)


def mixed_content(html: Column) -> Column:
    """How many references of a page go over plain http."""
    return F.regexp_count(html, F.lit(r"(?i)(?:src|href)=[\"']http://"))
