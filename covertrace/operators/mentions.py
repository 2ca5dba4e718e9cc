"""Entities named in articles: every place of every alias, the sentence, the role it gives."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covertrace.functions.text import sentence_around, without_marks

#: Shortest alias that is looked for; entities sent to the executors at once (more are taken in blocks, a pass over the articles each).
SHORTEST, DICTIONARY_LIMIT = 3, 100_000
#: Confidence with and without a cue; below the last a role is ambiguous.
CUED, UNCUED, AMBIGUOUS = 0.8, 0.3, 0.5
EVIDENCE_LENGTH = 1000

# Phrases that give a role, in the order in which roles are tried.
ROLE_CUES = (
    ("quoted_response", (
        "told the", "said in a statement", "in a statement", "a spokesperson", "spokesman", "spokeswoman", "declined to comment", "did not respond", "responded", "denied",
        "rejected the", "in an emailed", "when contacted", "udtaler", "oplyser", "afviser", "i en udtalelse", "ønsker ikke at kommentere")),
    ("named_supplier", (
        "supplies", "supplied", "supplier to", "sources from", "sourced from", "buys fishmeal from", "purchases from", "imports from", "sourcing from", "which supplies",
        "a supplier", "leverandør", "leverer til", "aftager fra")),
    ("named_buyer", ("buyer of", "bought from", "customer of", "purchased by", "sells to", "which buys", "clients include", "køber", "kunde hos", "sælger til")),
    ("subject", (
        "investigation into", "accused of", "at the centre of", "at the center of", "under investigation", "faces allegations", "named in the report", "the report names",
        "is alleged to", "under fire", "beskyldes for", "i centrum af", "undersøgelsen af")),
)


def folded(text: str) -> str:
    """Case-folded without marks; punctuation stays."""
    return without_marks(text).casefold()


def pattern_of(forms: list[str]) -> re.Pattern | None:
    """One pattern for all forms of an entity, the longest first, so that a shorter form within a longer one isn't counted."""
    alternatives = []
    for form in sorted({f.strip() for f in forms if f and len(f.strip()) >= SHORTEST}, key=lambda f: (-len(f), f)):
        body = r"\s+".join(re.escape(part) for part in folded(form).split())
        edged = re.match(r"\w", form) and re.match(r"\w", form[-1])
        alternatives.append((r"\b" if edged else "") + body + r"(?![\w-])")
    return re.compile("|".join(alternatives)) if alternatives else None


FOUND = "article_id long, campaign_id long, entity_id long, char_offset int, evidence_sentence string, sentence_form string"


def occurrences(articles: DataFrame, entities: DataFrame) -> DataFrame:
    """Each place of each entity (id, forms) in headline and body (headline alone without a body), one row a place.

    One automaton over the first words of all forms finds the entities that may stand in a text; only their
    patterns are tried. Articles are read once for each ``DICTIONARY_LIMIT`` entities, without a shuffle. Null texts have
    no place; aliases of under three characters are refused.
    """
    wanted = articles.select("id", "campaign_id", "headline", "body_text")
    blocks = max(1, -(-entities.count() // DICTIONARY_LIMIT))
    out = None
    for k in range(blocks):
        chosen = entities.select("id", "forms").where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)
        forms = [(r["id"], list(r["forms"] or [])) for r in chosen.orderBy("id").collect()]
        part = wanted.mapInPandas(_finder(articles.sparkSession.sparkContext.broadcast(forms)), FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def _finder(sent):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns = {i: p for i, f in sent.value if (p := pattern_of(f)) is not None}
        owners: dict[str, set] = defaultdict(set)
        for i, f in sent.value:
            for form in f:
                if form and len(form.strip()) >= SHORTEST and (parts := folded(form).split()):
                    owners[parts[0]].add(i)
        automaton = ahocorasick.Automaton()
        for word, of in owners.items():
            automaton.add_word(word, tuple(sorted(of)))
        if owners:
            automaton.make_automaton()
        for pdf in batches:
            rows = []
            for a, c, headline, body in zip(pdf["id"], pdf["campaign_id"], pdf["headline"], pdf["body_text"]):
                text = f"{headline or ''}\n\n{body}" if body else (headline or "")
                form = folded(text)
                near = {i for _, of in automaton.iter(form) for i in of} if owners and form else ()
                for entity in sorted(near):
                    for m in patterns[entity].finditer(form):
                        sentence = sentence_around(text, m.start())[:EVIDENCE_LENGTH]
                        rows.append((a, c, entity, m.start(), sentence, folded(sentence)))
            yield pd.DataFrame(rows, columns=["article_id", "campaign_id", "entity_id", "char_offset", "evidence_sentence", "sentence_form"])

    return find


def role_of(form: Column) -> Column:
    """The first role one of whose phrases stands in a folded sentence."""
    role = F.when(F.lit(False), "")
    for name, cues in ROLE_CUES:
        hit = F.lit(False)
        for cue in cues:
            hit = hit | form.contains(folded(cue))
        role = role.when(hit, name)
    return role.otherwise("passing_reference")


def mentions(articles: DataFrame, entities: DataFrame) -> DataFrame:
    """(article_id, campaign_id, entity_id, role, char_offset, confidence, evidence_sentence), one row per place."""
    found = occurrences(articles, entities).withColumn("role", role_of(F.col("sentence_form")))
    confidence = F.when(F.col("role") == "passing_reference", UNCUED).otherwise(CUED)
    return found.select("article_id", "campaign_id", "entity_id", "role", "char_offset", confidence.alias("confidence"), "evidence_sentence").dropDuplicates(["article_id", "entity_id", "role", "char_offset"])


def match_report(found: DataFrame) -> DataFrame:
    """(campaign_id, entity_id, role, mentions, ambiguous)."""
    return found.groupBy("campaign_id", "entity_id", "role").agg(F.count("*").alias("mentions"), F.count_if(F.col("confidence") < AMBIGUOUS).alias("ambiguous"))


def reviewed_roles(found: DataFrame, classify, batch: int = 25) -> DataFrame:
    """Mentions with roles of ambiguous ones taken from ``classify`` (sentences to (role, confidence) pairs), batch by batch.

    What it gives is checked: unknown roles are dropped, confidence is held within 0 and 1; a failing call leaves
    its batch as it was. Without a callable nothing changes.
    """
    if classify is None:
        return found
    known = {name for name, _ in ROLE_CUES} | {"passing_reference"}
    columns = found.columns

    def review(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            open_rows = pdf.index[pdf["confidence"] < AMBIGUOUS].tolist()
            for at in range(0, len(open_rows), batch):
                chosen = open_rows[at : at + batch]
                try:
                    answers = classify([pdf.at[i, "evidence_sentence"] for i in chosen])
                except Exception:
                    continue
                for i, answer in zip(chosen, answers):
                    if answer and answer[0] in known and answer[1] is not None:
                        pdf.at[i, "role"], pdf.at[i, "confidence"] = answer[0], min(1.0, max(0.0, float(answer[1])))
            yield pdf[columns]

    return found.mapInPandas(review, found.schema)
