"""Scalar functions as Column expressions; Python only where no built-in has the semantics."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_KINDS = tuple("dep lem ent chu iri".split())
EDGE_KINDS = tuple("dep chu inf syn iri".split())
IRI_BASE = "https://graphloom.example/ns/"
_DBPEDIA, _WIKIDATA, W3 = "http://dbpedia.org/", "http://www.wikidata.org/", "http://www.w3.org/"
_RESOURCE, _ONTOLOGY = _DBPEDIA + "resource/", _DBPEDIA + "ontology/"
#: (prefix, namespace), in the order in which they are tried.
PREFIXES: list[tuple[str, str]] = [
    ("dbc", _RESOURCE + "Category:"),
    ("dbt", _RESOURCE + "Template:"),
    ("dbr", _RESOURCE),
    ("yago", _DBPEDIA + "class/yago/"),
    ("dbd", _DBPEDIA + "datatype/"),
    ("dbo", _ONTOLOGY),
    ("dbp", _DBPEDIA + "property/"),
    ("units", _DBPEDIA + "units/"),
    ("dbpedia-commons", "http://commons.dbpedia.org/resource/"),
    ("dbpedia-wikicompany", "http://dbpedia.openlinksw.com/wikicompany/"),
    ("dbpedia-wikidata", "http://wikidata.dbpedia.org/resource/"),
    ("wd", _WIKIDATA),
    ("wd_ent", _WIKIDATA + "entity/"),
    ("rdf", W3 + "1999/02/22-rdf-syntax-ns#"),
    ("schema", "https://schema.org/"),
    ("owl", W3 + "2002/07/owl#"),
]
#: (label, class IRI, definition, short label) of entity kinds.
NER_CLASSES: list[tuple[str, str, str, str]] = [
    ("CARDINAL", _RESOURCE + "Cardinal_number", "a number of no other kind", "cardinal number"),
    ("DATE", _ONTOLOGY + "date", "a date or period", "date"),
    ("EVENT", _ONTOLOGY + "Event", "a named event", "event"),
    ("FAC", _ONTOLOGY + "Infrastructure", "a building, road or bridge", "infrastructure"),
    ("GPE", _ONTOLOGY + "Country", "a country, state or city", "country"),
    ("LANGUAGE", _ONTOLOGY + "Language", "a language", "language"),
    ("LAW", _ONTOLOGY + "Law", "a named law", "law"),
    ("LOC", _ONTOLOGY + "Place", "a place that is no state", "place"),
    ("MONEY", _RESOURCE + "Money", "an amount of money", "money"),
    ("NORP", _ONTOLOGY + "nationality", "a nation, faith or party", "nationality"),
    ("ORDINAL", _RESOURCE + "Ordinal_number", "an ordinal", "ordinal number"),
    ("ORG", _ONTOLOGY + "Organisation", "an organisation", "organization"),
    ("PERCENT", _RESOURCE + "Percentage", "a percentage", "percentage"),
    ("PERSON", _ONTOLOGY + "Person", "a person", "person"),
    ("PRODUCT", _ONTOLOGY + "product", "a product", "product"),
    ("QUANTITY", _RESOURCE + "Quantity", "a measured quantity", "quantity"),
    ("TIME", _ONTOLOGY + "time", "a time of less than a day", "time"),
    ("WORK_OF_ART", _RESOURCE + "Work_of_art", "a title of a work", "work of art"),
]


def lemma_key(lemma: Column, pos: Column) -> Column:
    return F.concat_ws(".", F.lower(F.trim(lemma)), pos)


def span_key(text: Column, pos: str) -> Column:
    """Key of a span of several words of one part of speech."""
    return F.array_join(F.transform(F.split(F.lower(text), " "), lambda w: F.concat(w, F.lit("." + pos))), ".")


def entity_iri(key: Column, base: str = IRI_BASE) -> Column:
    return F.concat(F.lit(base + "entity/"), F.translate(key, " .", "__"))


def denormalize_iri(iri: Column, base: str = IRI_BASE) -> Column:
    short = F.replace(F.replace(F.substr(iri, F.lit(len(base) + 1)), F.lit("entity/"), F.lit("")), F.lit("_"), F.lit("."))
    return F.when(F.startswith(iri, F.lit(base)), short).otherwise(iri)


def normalize_prefix(iri: Column, prefixes: list[tuple[str, str]] | None = None, compat: bool = False) -> Column:
    """Prefix form of an IRI by host and path, the scheme aside; unchanged where no namespace matches, null for null.

    The longest namespace wins; with compat, the first in order.
    """
    table = list(PREFIXES if prefixes is None else prefixes)
    if not compat:
        table.sort(key=lambda x: -len(x[1]))
    # a table that is searched: a branch for each prefix is more code than the JVM compiles
    rows = []
    for prefix, namespace in table:
        host, _, path = namespace.split("://", 1)[1].split("#", 1)[0].partition("/")
        rows.append(F.struct(F.lit(prefix + ":").alias("prefix"), F.lit(host).alias("host"), F.lit("/" + path).alias("path")))
    if not rows:
        return iri
    url = F.struct(*(F.try_parse_url(iri, F.lit(part)).alias(name) for part, name in (("HOST", "host"), ("PATH", "path"), ("REF", "ref"))))

    def short(u: Column) -> Column:
        hit = F.get(F.filter(F.array(*rows), lambda r: (r["host"] == u["host"]) & F.startswith(u["path"], r["path"])), F.lit(0))
        slug = lambda h: F.when(F.coalesce(F.length(u["ref"]), F.lit(0)) > 0, u["ref"]).otherwise(F.replace(u["path"], h["path"], F.lit("")))
        return F.concat(hit["prefix"], slug(hit))

    return F.coalesce(F.get(F.transform(F.array(url), short), F.lit(0)), iri)


def remap_ner(label: Column, classes: list[tuple[str, str, str, str]] | None = None) -> Column:
    """Class IRI of an entity label; null for an unknown one. Spaces and underscores are the same."""
    pairs = [F.lit(x) for row in (NER_CLASSES if classes is None else classes) for x in row[:2]]
    return F.try_element_at(F.create_map(*pairs), F.translate(label, " ", "_"))


def edge_key(src: Column, dst: Column, rel: Column, kind: Column) -> Column:
    return F.concat_ws(".", src, dst, F.translate(rel, " ", "_"), F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(EDGE_KINDS) for x in (k, i))), kind))


def relation_iri(iri: Column, rel: Column, source: str) -> Column:
    """IRI of a relation, or the relation's name in its source's namespace."""
    return F.coalesce(iri, F.concat(F.lit(source + ":"), F.translate(rel, " ", "_")))


def enum_decode(text: Column, names: tuple[str, ...] = NODE_KINDS) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n.upper(), i))), F.upper(F.trim(text)))


def enum_encode(code: Column, names: tuple[str, ...] = NODE_KINDS) -> Column:
    return F.get(F.array(*(F.lit(n) for n in names)), code)


def linked_label(entity_iris: Column, label: Column) -> Column:
    return F.coalesce(F.get(entity_iris, F.lit(0)), label)


def node_name(kind: Column, key: Column, text: Column, label: Column) -> Column:
    return F.when(kind == "iri", label).when(kind == "lem", key).otherwise(text)


def display_label(kind: Column, text: Column, label: Column) -> Column:
    """What a node is drawn with: nothing for words without content, the prefix form of a class's label, else its text."""
    return F.when(kind == "dep", "").when(kind == "iri", normalize_prefix(label)).otherwise(text)


def node_iri(kind: Column, key: Column, label: Column) -> Column:
    """IRI of a node: the key of a class, a label that is one, else null."""
    return F.when(kind == "iri", key).when(F.startswith(label, F.lit("http")), label)


def stacked_count(pos: Column, kind: Column, count: Column) -> Column:
    return F.when((pos == "VERB") | (kind == "iri"), 0).otherwise(count)


def char_span(idx: Column, text: Column) -> Column:
    return F.struct(idx.alias("first"), (idx + F.length(text) - 1).alias("last"))


def is_url(label: Column) -> Column:
    return F.rlike(label, F.lit("https*://"))


def quantile_groups(n: Column) -> Column:
    """Number of quantile bounds for n rows."""
    return F.greatest(F.bround(F.ln(n) * 4).cast("int"), F.lit(1))


def quantile_bins(n: Column) -> Column:
    g = quantile_groups(n)
    return F.transform(F.sequence(F.lit(0), g - 1), lambda k: F.when(g == 1, F.lit(0.0)).when(k == g - 1, F.lit(1.0)).otherwise(k * (F.lit(1.0) / (g - 1))))


def nearest_quantiles(values: Column, n: Column) -> Column:
    """Quantiles of a sorted array by the nearest rank, halves to even."""
    return F.transform(quantile_bins(n), lambda b: F.get(values, F.bround(b * 100 / 100 * (n - 1)).cast("int")))


def stripe(x: Column, quantiles: Column) -> Column:
    """Number of the quantile stripe of a normalised value; -1 for null."""
    return F.when(x.isNull(), -1).otherwise(F.size(F.filter(quantiles, lambda q: q <= x)) - 1)


def root_mean_square(*values: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, (v * v for v in values)) / len(values))


def best_alias(query: str, label: str, aliases: list[str]) -> tuple[float, str]:
    """Similarity of the best of label and aliases, and that name; the greatest of equally good ones, the first exact one."""
    wanted = query.lower()
    if wanted == label.lower():
        return 1.0, label
    found = []
    for name in [label, *aliases]:
        ratio = SequenceMatcher(None, wanted, name.lower()).ratio()
        found.append((ratio, name))
        if ratio == 1.0:
            break
    return max(found)


@F.pandas_udf(T.StructType([T.StructField("prob", T.DoubleType()), T.StructField("name", T.StringType())]))
def match_aliases(query: pd.Series, label: pd.Series, aliases: pd.Series) -> pd.DataFrame:
    """best_alias; null where query or label is."""
    rows = [best_alias(q, x, [] if a is None else [y for y in a if y is not None]) if q is not None and x is not None else (None, None) for q, x, a in zip(query, label, aliases)]
    return pd.DataFrame(rows, columns=["prob", "name"])


def markdown_text(text: Column) -> Column:
    """Plain text of simple Markdown or HTML: links by their text, emphasis and tags removed."""
    out = F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", ""), r"[*_`#]+", ""))


def tagged_triplets(text: str | None) -> list[dict[str, str]]:
    """Typed triples of a generated text such as '<triplet> A <per> B <loc> lives in'."""
    cleaned = text or ""
    for mark in ("<s>", "<pad>", "</s>", "tp_XX", "__en__"):
        cleaned = cleaned.replace(mark, "")
    out: list[dict[str, str]] = []
    state, part, kind = None, {"subject": [], "object": [], "relation": []}, {"head": "", "tail": ""}

    def flush() -> None:
        if part["subject"] and part["object"] and part["relation"] and kind["head"] and kind["tail"]:
            out.append({"head": " ".join(part["subject"]), "head_type": kind["head"], "rel": " ".join(part["relation"]), "tail": " ".join(part["object"]), "tail_type": kind["tail"]})
        part["relation"] = []

    for word in cleaned.split():
        if word in ("<triplet>", "<relation>"):
            if state == "relation":
                flush()
            state, part["subject"], part["object"], part["relation"] = "subject", [], [], []
            kind.update(head="", tail="")
        elif word.startswith("<") and word.endswith(">"):
            if state in ("subject", "relation"):
                if state == "relation":
                    flush()
                state, kind["head"], part["object"] = "object", word[1:-1], []
            elif state == "object":
                state, kind["tail"], part["relation"] = "relation", word[1:-1], []
        elif state:
            part[state].append(word)
    flush()
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("head", "head_type", "rel", "tail", "tail_type")])))
def parse_triplets(text: pd.Series) -> pd.Series:
    return text.map(tagged_triplets)
