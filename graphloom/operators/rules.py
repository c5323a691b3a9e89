"""Words and patterns by which texts become tokens; the SQL of the queries states the same."""

from __future__ import annotations

from ..functions import scalars as S

#: Runs of two or more capitalised words are one token (an entity); else words and single marks.
TOKEN = r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)+|[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
SENTENCE = r"[^.!?]+[.!?]*"
DETERMINERS = ("the", "a", "an", "der", "die", "das", "la", "le", "el", "los", "las", "les", "un", "une", "ein", "eine")
ADPOSITIONS = ("of", "in", "to", "on", "at", "by", "for", "from", "with", "de", "en", "von", "zu", "mit", "pour", "dans", "con", "para")
VERB_ENDINGS = ("ed", "ing")
RDF_TYPE = S.W3 + "1999/02/22-rdf-syntax-ns#type"
