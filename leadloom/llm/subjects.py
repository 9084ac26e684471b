"""Subject areas of texts: curated weighted terms, a multi-pattern automaton, rarity, calibrated thresholds.

A text is cleaned and cut into sentences, and an automaton finds all terms of all subjects in one pass over it; what it finds is
stored, texts are not read again. A sentence's score for a subject is the sum of its terms' weights times their rarity in the
corpus, over the root of the sentence's length. A text's level for a subject is the score that just a fifth of its sentences
reach; the subject is assigned where the level exceeds the subject's threshold, fitted on labelled rows.
"""

from __future__ import annotations

import html
import json
import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom.functions.reviews import TEXT_KEYS
from leadloom.llm.subject_terms import FIGURES, PASSING, TERMS
from leadloom.shared import cut_lineage

#: The share of sentences from which a subject counts.
SHARE = 0.2
#: A sentence counts for every subject whose score is at least this share of the sentence's highest.
BESIDE = 0.8
#: A subject with fewer labels than this keeps the threshold fitted for all subjects together.
OWN_LABELS = 40

_TAG = re.compile(r"<[a-zA-Z/!][^<>]*>|\{\{\w*\}\}|<\|\w*\|>|%[0-9A-Fa-f]{2}|\[\w{0,2}\]|#{2,}|\\[nrt]|&[a-zA-Z]+;|&#?\w{0,6};")
_MARKS = frozenset("<{%[#\\&")
_NOISE = re.compile(r"[­​-‏⁠﻿�]")
_SPACE = re.compile(r"[^\S\n]+")
_MOJIBAKE = re.compile(r"[ÃÂãâ][\u0080-¿‐-›€™œžŸ]")
_VALUES = re.compile(rf'"[^"\n]{{0,12}}(?:{"|".join(TEXT_KEYS)})[^"\n]{{0,12}}"\s*:\s*"((?:[^"\\]|\\.)*)', re.IGNORECASE)
_URL = re.compile(r"(?:https?://|www\.)\S+")
_LABEL = re.compile(r"^\s*(?:(?:critical|high|medium|low|q|a)\s*:\s*|[-*•]\s*|\d+[.)]\s+)+", re.IGNORECASE)
_ENDS = re.compile(r"(?<=[.!।؟])[\"')\]]*\s+|\n+")
_WORDS = re.compile(r"[^\W_]+")
_NO_WORDS = re.compile(r"(?:[^\w\n]|_)+")
#: Lines that greet or close (general forms), and scores by themselves.
_POLITE = re.compile(r"(?:hi|hello|dear|hey) (?:\w+ ?){1,2}[,!]?|(?:best|kind|warm) (?:regards|wishes)\b.*|(?:yours )?(?:sincerely|faithfully)\b.*|\(.*\)")
_SCORE = re.compile(r"(?:\w+ ){1,3}\d+ ?/ ?\d+\.?")


class _Letters(dict):
    """What becomes of each character: kept, a blank, or nothing. Found out once for each character."""

    def __missing__(self, code: int):
        c = chr(code)
        if c.isspace():
            out = c if c == "\n" else " "
        elif unicodedata.combining(c) or not (c in ".,;:!?'-|>·/()[]\"©{}" or c.isalnum()):
            out = None
        else:
            out = c
        self[code] = out
        return out


_LETTERS = _Letters()


def normal_text(text: str) -> str:
    """Lower case without accents, marks, invisible characters and symbols; runs of blanks are one."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _NOISE.sub("", text).replace("ß", "ss").replace("æ", "ae").replace("œ", "oe").replace("’", "'"))
    return _SPACE.sub(" ", text.translate(_LETTERS))


def plain_text(text: str) -> str:
    """Texts out of review lists, markup and damage: one string with line breaks between parts."""
    text = text.strip()
    inner = re.sub(r"^(?:<[^<>]*>\s*)+|(?:\s*<[^<>]*>)+$", "", text) if text[:1] == "<" else text
    if inner.startswith("["):
        try:
            rows = json.loads(inner)
            parts = [str(v) for row in rows if isinstance(row, dict) for k, v in row.items() if k.lower() in TEXT_KEYS]
            text = "\n".join(parts) if parts else inner
        except (ValueError, RecursionError):
            parts = _VALUES.findall(inner)
            text = "\n".join(parts) if parts else inner
            text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)
            text = text.replace('\\"', '"').replace("\\n", "\n")
    if "<" in text:
        text = re.sub(r"</(?:p|div|li|h\d|tr)>|<br\s*/?>", "\n", text)
    if "&" in text:
        text = html.unescape(text)
    for _ in range(0 if text.isascii() else 2):
        if _MOJIBAKE.search(text):
            text = _MOJIBAKE.sub(_repair, text)
    if not _MARKS.isdisjoint(text):
        text = _TAG.sub("", text)
    return _URL.sub(" ", text) if "http" in text or "www." in text else text


def _repair(found: re.Match) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return found[0].encode(code).decode("utf-8")
        except UnicodeError:
            continue
    return found[0]


def sentences(text: str | None) -> list[str]:
    """Sentences of a text, in normal form. A question and the answer behind it in its line are one; greetings, menus, footers,
    headings and other lines that aren't sentences are left out."""
    if not text:
        return []
    out = []
    for part in _ENDS.split(normal_text(plain_text(text))):
        part = _LABEL.sub("", part.strip(" \"'{}[]")).strip(" \"'{}[]")
        if len(part) < 2 or not any(map(str.isalpha, part)):
            continue
        if part[0] == "©" or part.count("|") + part.count(">") + part.count("·") + part.count("[") >= 2 or part.count(" / ") >= 2 or _POLITE.fullmatch(part) or _SCORE.fullmatch(part):
            continue
        if part[-1] in ",:" and len(part) < 40:
            continue
        if re.fullmatch(r"(?:guest|gast|invitado|client)\s*\d*", part):
            continue
        out.append(part)
    return out


class Matcher:
    """All terms in one automaton."""

    def __init__(self, terms: dict[str, str] = TERMS):
        import ahocorasick

        self.subjects = list(terms)
        self.rows: list[tuple[str, int, float, bool]] = []  # term, subject, weight, only whole words
        self.automaton = ahocorasick.Automaton()
        for s, text in enumerate(terms.values()):
            for entry in text.split(";"):
                term = " ".join(entry.split())
                if not term:
                    continue
                weight = None
                if m := re.match(r"(\d+(?:\.\d+)?):\s*(.+)", term):
                    weight, term = float(m[1]), m[2]
                whole = term.startswith("=")
                term = " ".join(_WORDS.findall(normal_text(term.lstrip("="))))
                self.automaton.add_word(" " + term, len(self.rows))
                self.rows.append((term, s, weight or (2.0 if " " in term else 1.0), whole))
        for phrase in (*PASSING, *FIGURES):
            self.automaton.add_word(" " + phrase, -1)
        self.automaton.make_automaton()

    def find_all(self, parts: list[str]) -> dict[int, list[int]]:
        """By sentence the rows of its terms, the longest first where they overlap; none where it is a passing mention or a figure."""
        text = " " + " \n ".join(_NO_WORDS.sub(" ", p).strip() for p in parts) + " "
        begins = None
        by: dict[int, list[tuple]] = {}
        void = set()
        for end, row in self.automaton.iter(text):
            if begins is None:
                begins = [0, *(m.end() for m in re.finditer(" \n", text))]
            if row < 0:
                void.add(bisect_right(begins, end) - 1)
                continue
            term, _, _, whole = self.rows[row]
            rest, most = 0, 0 if whole else 3 if len(term) < 6 else 10
            while text[end + 1 + rest] != " " and rest <= most:
                rest += 1
            if rest <= most:
                by.setdefault(bisect_right(begins, end) - 1, []).append((-len(term), end - len(term), end, row))
        out = {}
        for k, found in by.items():
            if k in void:
                continue
            if len(found) > 1:
                taken: list[tuple[int, int]] = []
                rows = []
                for _, begin, end, row in sorted(found):
                    if all(end < a or begin > b for a, b in taken):
                        taken.append((begin, end))
                        rows.append(row)
                out[k] = rows
            else:
                out[k] = [found[0][3]]
        return out


_OF_WORKER: list[Matcher] = []


def matcher() -> Matcher:
    if not _OF_WORKER:
        _OF_WORKER.append(Matcher())
    return _OF_WORKER[0]


def hits_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, total, sentence, words, term): how many sentences a text has, and for each term found its sentence, that one's
    length and the term's number, as arrays. The only pass over the texts; those without terms are left out."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = matcher()
        for batch in batches:
            out = []
            for k, t in zip(batch.doc_id, batch.text, strict=True):
                parts = sentences(t)
                found = m.find_all(parts) if parts else {}
                if found:
                    flat = [(i, parts[i].count(" ") + 1, r) for i, rows in found.items() for r in rows]
                    out.append((k, len(parts), *map(list, zip(*flat, strict=True))))
            yield pd.DataFrame(out, columns=["doc_id", "total", "sentence", "words", "term"])

    read = _spread(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")))
    return cut_lineage(read.mapInPandas(run, f"doc_id {kind}, total int, sentence array<int>, words array<int>, term array<int>"))


def _spread(df: DataFrame) -> DataFrame:
    """In at least two partitions for each core; a file that is one split is spread by rounds."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if len(df.inputFiles()) < cores else df


def term_rarity(hits: DataFrame, texts: int) -> np.ndarray:
    """Rarity of each term: log of corpus size over the texts that have it, in 0 to 1. Counts cover all texts; what comes to the
    driver is one number for each of the curated terms."""
    counts = np.zeros(len(matcher().rows))
    for r in hits.select(F.explode(F.array_distinct("term")).alias("term")).groupBy("term").count().collect():
        counts[r.term] = r["count"]
    total = max(texts, 2)
    return np.log1p(total / (1 + counts)) / math.log(1 + total)


def levels(hits: DataFrame, rarity: np.ndarray, share: float = SHARE) -> DataFrame:
    """(doc_id, subject, level): the score that ``share`` of a text's sentences reach, by subject with that many scored sentences."""
    kind = hits.schema["doc_id"].dataType.simpleString()
    names = np.array(matcher().subjects)
    value = np.array([w for _, _, w, _ in matcher().rows]) * rarity
    subject = np.array([s for _, s, _, _ in matcher().rows])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            doc = np.repeat(np.arange(len(batch)), batch.term.map(len))
            sentence, words, term = (np.concatenate(batch[c].to_numpy()).astype(np.int64) for c in ("sentence", "words", "term"))
            # One number for each sentence and subject of it.
            place, score = np.unique((doc << 40 | sentence << 8 | subject[term]), return_inverse=True)
            score = np.bincount(score, value[term] / np.sqrt(words / 10))
            _, of = np.unique(place >> 8, return_inverse=True)
            best = np.zeros(of.max() + 1)
            np.maximum.at(best, of, score)
            kept = score >= BESIDE * best[of]
            place, score = place[kept], score[kept]
            group = (place >> 40) << 8 | (place & 255)
            order = np.lexsort((-score, group))
            group, score = group[order], score[order]
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            size = np.diff(np.append(first, len(group)))
            need = np.maximum(np.ceil(batch.total.to_numpy()[group[first] >> 8] * share - 1e-9).astype(np.int64), 1)
            ok = size >= need
            at = first[ok] + need[ok] - 1
            yield pd.DataFrame({"doc_id": batch.doc_id.to_numpy()[group[at] >> 8], "subject": names[group[at] & 255], "level": score[at]})

    return hits.mapInPandas(run, f"doc_id {kind}, subject string, level double")


def best_threshold(level: np.ndarray, true: np.ndarray, missed: int = 0) -> float:
    """The threshold of the best F1, half way between levels; the lowest one of the best. missed: labels without a level."""
    order = np.argsort(-level, kind="stable")
    level, true = level[order], true[order].astype(float)
    if not len(level) or not true.any():
        return 0.0
    f1 = 2 * np.cumsum(true) / (np.arange(1, len(level) + 1) + true.sum() + missed)
    last = np.append(level[:-1] != level[1:], True)  # equal levels go together
    at = int(np.flatnonzero(last & (f1 >= f1[last].max() - 1e-12))[-1])
    return float((level[at] + (level[at + 1] if at + 1 < len(level) else 0.0)) / 2)


def calibrate(found: DataFrame, labels: DataFrame) -> dict[str, float]:
    """A threshold for each subject from the levels of all labelled rows, by the rule of best_threshold. A subject of few labels has
    the one fitted for all. Levels are ranked by range partitions and their sums, so that no subject is a single task's; what comes
    to the driver is a threshold for each subject."""
    clean = cut_lineage(labels.select("doc_id", F.regexp_replace(F.lower(F.trim("subject")), "[^a-z]+", "_").alias("subject")).filter("doc_id is not null and subject is not null").distinct())
    rows = found.join(clean.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = rows.join(clean.withColumn("true", F.lit(1)), ["doc_id", "subject"], "full").select("subject", "level", F.coalesce("true", F.lit(0)).alias("true"))
    both = rows.select(F.explode(F.array("subject", F.lit("*"))).alias("of"), "level", "true")  # * is all subjects together
    counted = cut_lineage(both.groupBy("of", "level").agg(F.count("*").alias("n"), F.sum("true").alias("true")))
    labelled = counted.groupBy("of").agg(F.sum("true").alias("labels"))  # those without a level too
    parts = counted.filter("level is not null").repartitionByRange("of", F.desc("level")).withColumn("part", F.spark_partition_id())
    parts = cut_lineage(parts)
    before = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("of", "part").agg(F.sum("n").alias("n"), F.sum("true").alias("true"))  # one row per subject and partition
    sums = sums.select("of", "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "true")])
    upto = Window.partitionBy("of", "part").orderBy(F.desc("level"))
    ranked = parts.select("of", "part", "level", F.sum("n").over(upto).alias("n"), F.sum("true").over(upto).alias("true")).join(sums, ["of", "part"]).join(labelled, "of")
    f1 = 2 * (F.col("true") + F.col("true_before")) / (F.col("n") + F.col("n_before") + F.col("labels"))
    ranked = cut_lineage(ranked.select("of", "level", "labels", f1.alias("f1")))
    best = ranked.filter("labels > 0").groupBy("of").agg(F.max("f1").alias("best"))
    least = ranked.join(best, "of").filter(F.col("f1") >= F.col("best") - 1e-12).groupBy("of").agg(F.min("level").alias("least"))
    below = parts.join(least, "of").filter("level < least").groupBy("of").agg(F.max("level").alias("below"))
    fitted = labelled.join(least, "of", "left").join(below, "of", "left").select("of", "labels", F.coalesce((F.col("least") + F.coalesce("below", F.lit(0.0))) / 2, F.lit(0.0)).alias("threshold"))
    fit = {r.of: r for r in fitted.filter(F.col("of").isin("*", *matcher().subjects)).collect()}
    every = fit["*"].threshold if "*" in fit else 0.0
    return {s: fit[s].threshold if s in fit and fit[s].labels >= OWN_LABELS else every for s in matcher().subjects}


def assign_subjects(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, subject, level): every subject that at least a fifth of a text's sentences are about.

    Null, empty and blank texts and texts without a subject have no rows. Repeated rows are assigned each for itself. ``labels``
    (doc_id, subject) fit the thresholds; without them every level counts. Other columns aren't read. An empty table gives an
    empty result. Whole texts are read, once; the only shuffles are of term counts and, to fit on all labels, of levels and labels.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    hits = hits_of(docs)
    found = levels(hits, term_rarity(hits, docs.count()))
    if labels is None:
        return found
    least = calibrate(found, labels)
    return found.filter(F.col("level") > F.create_map(*[F.lit(x) for kv in least.items() for x in kv])[F.col("subject")])
