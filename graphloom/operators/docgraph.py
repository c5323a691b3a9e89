"""Tokens and graphs of documents by the rules of textgraph, whole graphs in one task, on arrays.

The operators of textgraph take tokens of any backend and join them; here a graph is made at once from its document, so
that nothing but the documents themselves is shuffled (rows of one doc_id are one graph), and only what is asked for
leaves the task. Memory is that of BLOCK characters, or of the longest graph.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions import scalars as S
from . import paths, rank, rules

#: Characters of text from which a block of whole graphs is worked on.
BLOCK = 1 << 20
POS = ("NOUN", "PROPN", "VERB", "DET", "ADP", "NUM", "PUNCT")
NOUN, PROPN, VERB, DET, ADP, NUM, PUNCT = range(7)
DEPS = ("root", "pobj", "nsubj", "det", "prep", "punct", "dep")
RELS = (*DEPS, "noun_chunk", rules.RDF_TYPE)
KINDS = ("ent", "lem", "dep", "chu", "iri")
LABELS = ("GPE", "PERSON")
CLASS = {label: (iri, text, short) for label, iri, text, short in S.NER_CLASSES}


@cache
def _classes() -> np.ndarray:
    """By code point: 1 capital, 2 other letter, 3 number, 4 white space, 5 end of a sentence, 0 any other mark."""
    of = {"Lu": 1, "Ll": 2, "Lt": 2, "Lm": 2, "Lo": 2, "Nd": 3, "Nl": 3, "No": 3}
    table = np.fromiter((of.get(unicodedata.category(chr(c)), 0) for c in range(0x110000)), np.uint8, 0x110000)
    table[[9, 10, 12, 13, 32]] = 4
    table[[ord(c) for c in ".!?"]] = 5
    return table


def _taken(names: tuple, codes: np.ndarray) -> pa.Array:
    return pa.array(names, pa.string()).take(pa.array(codes))


def _joined(*parts: pa.Array | str, by: str = "") -> pa.Array:
    return pc.binary_join_element_wise(*(pa.scalar(p) if isinstance(p, str) else p for p in parts), by)


def _text(numbers: np.ndarray) -> pa.Array:
    return pc.cast(pa.array(numbers), pa.string())


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of integers: where each of the distinct ones is first, which of them each is, and how often."""
    _, first, which, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return first, which, count


def _spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from lo to before hi of every span, and whose they are."""
    n = hi - lo
    whose = np.repeat(np.arange(len(lo)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), whose


class Tokens:
    """Tokens of several documents, in order of graph, paragraph, sentence and place.

    g, para, sent, tok, head: by token, g by position among the graphs; code: which distinct text; pos and dep by
    position in POS and DEPS; key: which distinct key (words without content: of the text alone).
    """

    def __init__(self, ids: pa.Array, texts: list[str]):
        n_docs = len(texts)
        joined = "\n".join(texts) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        cls = _classes()[cp]
        line = cp == 10
        doc_start = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, n_docs) + 1)[:-1]])
        word = (cls > 0) & (cls < 4)
        before = np.concatenate([[False], word[:-1]])
        ws, we = np.flatnonzero(word & ~before), np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
        begins, ends = np.zeros(len(cp), bool), np.zeros(len(cp) + 1, bool)
        marks = np.flatnonzero((cls == 0) | (cls == 5))
        begins[marks], ends[marks + 1] = True, True
        if len(ws):
            # two or more capitalised words, one space between them, are one token; digits end the last
            digits = np.concatenate([np.flatnonzero(cls == 3), [len(cp)]])
            letters = np.minimum(digits[np.searchsorted(digits, ws)], we)
            cap = (cls[ws] == 1) & (letters - ws > 1)
            linked = np.concatenate([cap[:-1] & (letters == we)[:-1] & cap[1:] & (cp[we[:-1]] == 32) & (ws[1:] == we[:-1] + 1), [False]])
            follows = np.concatenate([[False], linked[:-1]])
            begins[ws[~follows]] = True
            cut = follows & ~linked & (letters < we)
            ends[np.where(cut, letters, we)[~linked]] = True
            begins[letters[cut]], ends[we[cut]] = True, True
        # a sentence is what ends no sentence up to what ends it; marks before the first are of none
        para_start = np.concatenate([[True], line[:-1]])
        stop = cls == 5
        sent_start = ~stop & ~line & (para_start | np.concatenate([[False], stop[:-1]]))
        n_sents = np.cumsum(sent_start)
        para = np.cumsum(para_start) - 1
        first_char = np.flatnonzero(para_start)
        sents_before = n_sents[first_char] - sent_start[first_char]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends)
        sent = n_sents[start] - sents_before[para[start]] - 1
        inside = sent >= 0
        start, end, sent = start[inside], end[inside], sent[inside]
        g = np.searchsorted(doc_start, start, "right") - 1
        whole = n_sents[start]
        new = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]])) if len(start) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([new, [len(start)]]))
        first, last = np.repeat(new, size), np.repeat(new + size - 1, size)
        at = np.arange(len(start))

        raw = np.frombuffer(joined.encode(), np.uint8)
        at_byte = np.arange(len(cp) + 1) if len(raw) == len(cp) else np.concatenate([[0], np.cumsum(1 + (cp > 0x7F).astype(np.int8) + (cp > 0x7FF) + (cp > 0xFFFF))])
        lo, hi = at_byte[start], at_byte[end]
        cover = np.zeros(len(raw) + 1, np.int8)
        cover[lo] += 1
        cover[hi] -= 1
        kept = raw[np.cumsum(cover[:-1], dtype=np.int8) > 0]
        offsets = np.concatenate([[0], np.cumsum(hi - lo)]).astype(np.int32)
        found = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.tobytes()), pa.py_buffer(kept.tobytes())).dictionary_encode()
        self.texts = found.dictionary
        code = found.indices.to_numpy()
        self.lowers = pc.utf8_lower(self.texts)
        self.spaced = pc.match_substring(self.texts, " ").to_numpy(zero_copy_only=False)
        flag = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
        self.pos_of = np.full((2, len(self.texts)), NOUN, np.int8)
        if len(self.texts):
            one = np.zeros(len(self.texts), np.uint8)
            one[code] = cls[start]
            mark, capital = (one == 0) | (one == 5), one == 1
            ending = np.logical_or.reduce([flag(pc.ends_with(self.lowers, e)) for e in rules.VERB_ENDINGS]) & flag(pc.greater(pc.utf8_length(self.texts), 4))
            for k in (0, 1):  # later tokens, first tokens
                p = self.pos_of[k]
                p[ending] = VERB
                if not k:
                    p[capital] = PROPN
                p[flag(pc.is_in(self.lowers, pa.array(rules.ADPOSITIONS)))] = ADP
                p[flag(pc.is_in(self.lowers, pa.array(rules.DETERMINERS)))] = DET
                p[flag(pc.match_substring_regex(self.texts, r"^\p{N}+$"))] = NUM
                p[mark] = PUNCT
                p[self.spaced] = PROPN
        # distinct keys, of the lower-cased text with the part of speech
        low = self.lowers.dictionary_encode()
        pairs = low.indices.to_numpy().astype(np.int64) * len(POS) + self.pos_of
        kinds, key_of = np.unique(pairs, return_inverse=True)
        key_of = key_of.reshape(pairs.shape)
        name, tag = low.dictionary.take(pa.array(kinds // len(POS))), _taken(POS, kinds % len(POS))
        self.pieces = _joined(name, tag, by=".")  # as chunks are named
        self.keys = pc.if_else(pc.match_substring(name, " "), _joined(pc.replace_substring(name, " ", ".PROPN."), ".PROPN"), self.pieces)
        self.key_pos = (kinds % len(POS)).astype(np.int8)

        tok = at - first
        pos = np.where(tok == 0, self.pos_of[1][code], self.pos_of[0][code])
        content = np.flatnonzero(pos <= VERB)
        later = np.concatenate([content, [len(at)]])[np.searchsorted(content, at, "right")]
        head = np.minimum(later, last)
        verbs = np.concatenate([np.flatnonzero(pos == VERB), [len(at)]])
        verb = np.where((v := verbs[np.searchsorted(verbs, new)]) <= new + size - 1, v, -1)
        verb = np.repeat(verb, size)
        noun = (pos == NOUN) | (pos == PROPN)
        after_adp = np.concatenate([[False], pos[:-1] == ADP])[: len(at)] & (tok > 0)
        self.dep = np.select([head == at, noun & after_adp, noun & (at < verb), pos == DET, pos == ADP, pos == PUNCT], [0, 1, 2, 3, 4, 5], 6).astype(np.int8)
        self.g, self.para, self.sent, self.tok, self.head = g, (para[start] - para[doc_start][g]).astype(np.int32), sent.astype(np.int32), tok.astype(np.int32), (head - first).astype(np.int32)
        self.code, self.pos, self.key = code, pos, np.where(tok == 0, key_of[1][code], key_of[0][code])
        self.ids = ids
        self.repeated = False
        self._one_graph_each()

    def _one_graph_each(self) -> None:
        """Rows of one id (they follow each other) as one graph, its tokens in order of their places."""
        dense = self.ids.dictionary_encode().indices.to_numpy()
        if len(dense) == 0 or dense[-1] == len(dense) - 1:
            return
        self.repeated = True
        self.ids = self.ids.unique()
        self.g = dense[self.g].astype(np.int64)
        by_text = np.empty(len(self.texts), np.int64)
        by_text[pc.sort_indices(pc.cast(self.texts, pa.binary())).to_numpy()] = np.arange(len(self.texts))
        order = np.lexsort((by_text[self.code], self.tok, self.sent, self.para, self.g))
        for name in ("g", "para", "sent", "tok", "head", "code", "pos", "key", "dep"):
            setattr(self, name, getattr(self, name)[order])

    def __len__(self) -> int:
        return len(self.g)

    @cached_property
    def kind(self) -> np.ndarray:
        """By position in KINDS."""
        return np.where(self.pos == PROPN, 0, np.where((self.pos == NOUN) | (self.pos == VERB), 1, 2)).astype(np.int8)

    def _numbered(self, *columns: np.ndarray) -> np.ndarray:
        """Which run of equal values in all columns each token is of."""
        new = np.zeros(len(self), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        return np.cumsum(new)

    @cached_property
    def place(self) -> np.ndarray:
        """Sentence of each token, numbered."""
        return self._numbered(self.g, self.para, self.sent)

    @cached_property
    def paragraph(self) -> np.ndarray:
        return self._numbered(self.g, self.para)

    @cached_property
    def slot(self) -> np.ndarray:
        """Place in the sentence of each token, numbered: its own, but for repeated ids."""
        return self._numbered(self.g, self.para, self.sent, self.tok) if self.repeated else np.arange(len(self))

    def at(self, place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens at places lo to hi of sentences, and which of the asked they are of."""
        wide = int(self.tok.max(initial=0)) + 2
        there = self.place * wide + self.tok
        return _spans(np.searchsorted(there, place * wide + lo), np.searchsorted(there, place * wide + np.minimum(hi, wide - 1), "right"))

    @cached_property
    def names(self) -> pa.Array:
        """Keys of tokens: of words without content with their place, as they never merge."""
        key = self.keys.take(pa.array(self.key))
        where = np.flatnonzero(self.kind == 2)
        own = _joined(_text_of(self.ids).take(pa.array(self.g[where])), *(_text(c[where]) for c in (self.para, self.sent, self.tok)), key.take(pa.array(where)), by=".")
        return pc.replace_with_mask(key, pa.array(self.kind == 2), own)

    @cached_property
    def offset(self) -> np.ndarray:
        """Words of its paragraph before each token."""
        before = np.cumsum(self.length) - self.length
        new = np.flatnonzero(np.concatenate([[True], self.paragraph[1:] != self.paragraph[:-1]])) if len(self) else np.zeros(0, np.int64)
        return (before - before[new][self.paragraph] if len(self) else before).astype(np.int32)

    @cached_property
    def length(self) -> np.ndarray:
        words = pc.add(pc.count_substring(self.texts, " "), 1).to_numpy(zero_copy_only=False).astype(np.int32)
        return words[self.code]

    @cached_property
    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, parts, whose): the first token of every chunk, all tokens of chunks, and the chunk of each of these."""
        new = np.zeros(len(self), bool)
        new[1:] = self.place[1:] != self.place[:-1]
        new[:1] = True
        noun = (self.pos == NOUN) | (self.pos == PROPN)
        may = noun | (self.pos == DET)
        begins = may & (new | ~np.concatenate([[False], may[:-1]])[: len(self)])
        sentence, start, broken = (np.maximum.accumulate(np.where(x, self.slot, -1)) for x in (new, begins, ~noun & ~begins))
        if self.repeated:  # what shares a place counts at once
            last = np.searchsorted(self.slot, self.slot, "right") - 1
            start, broken = start[last], broken[last]
        inside = np.flatnonzero((start >= sentence) & (broken <= start))
        first, whose, n = _groups(start[inside])
        many = n > 1
        part = many[whose]
        renumbered = np.cumsum(many) - 1
        return inside[first[many]], inside[part], renumbered[whose[part]]

    @cached_property
    def chunk_names(self) -> tuple[pa.Array, np.ndarray]:
        """Keys and lengths of chunks."""
        first, parts, whose = self.chunks
        n = np.bincount(whose, minlength=len(first))
        return pc.binary_join(_lists(n, self.pieces.take(pa.array(self.key[parts]))), "."), n.astype(np.int32)

    @cached_property
    def chunk_texts(self) -> pa.Array:
        first, parts, whose = self.chunks
        return pc.binary_join(_lists(np.bincount(whose, minlength=len(first)), self.texts.take(pa.array(self.code[parts]))), " ")


def _text_of(ids: pa.Array) -> pa.Array:
    return pc.cast(ids, pa.string())


class Graph:
    """Nodes and edges of the tokens of several graphs: nodes of tokens, of chunks, of classes; edges by positions of nodes."""

    def __init__(self, toks: Tokens):
        self.toks, self.ids = toks, toks.ids
        width = len(toks.keys) + 1
        content = toks.kind != 2
        leader = np.arange(len(toks))
        if toks.repeated and len(toks):  # words without content of equal places and keys
            first, which, _ = _groups(toks.slot * width + toks.key)
            leader = first[which]
        coded = np.where(content, toks.g * width + toks.key, len(self.ids) * width + leader)
        self.first, self.node, n = _groups(coded)
        self.content_codes, self.width = coded[self.first], width
        self.n_tokens = len(self.first)
        self.kind = toks.kind[self.first]
        self.g = toks.g[self.first]
        self.count = np.where(self.kind == 2, 0, n).astype(np.int64)
        self.sub_obj = np.zeros(self.n_tokens, bool)
        self.sub_obj[self.node[(toks.dep == 1) | (toks.dep == 2)]] = True
        #: 0 or 1 by LABELS for entities, -1 for others
        self.label = np.where(self.kind == 0, toks.spaced[toks.code[self.first]].astype(np.int8), -1) if self.n_tokens else np.zeros(0, np.int8)

    @cached_property
    def dep_edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(src, dst, rel, count) of dependencies."""
        t = self.toks
        if t.repeated:
            to, of = t.at(t.place, t.head, t.head)
        else:
            at = np.arange(len(t))
            to, of = at + t.head - t.tok, at
        src, dst, rel = self.node[of], self.node[to], t.dep[of]
        return self._merged(src, dst, rel)

    def _merged(self, src: np.ndarray, dst: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        apart = src != dst
        src, dst, rel = src[apart].astype(np.int64), dst[apart], rel[apart]
        first, _, n = _groups((src * max(1, self.n_tokens) + dst) * len(RELS) + rel)
        return src[first], dst[first], rel[first], n.astype(np.int64)

    @cached_property
    def fresh(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, node, first): the chunks whose key is no node yet, which chunk node they are, and the chunk that names each of these."""
        t = self.toks
        first, _, _ = t.chunks
        found = t.chunk_names[0].dictionary_encode()
        code = found.indices.to_numpy().astype(np.int64)
        same = pc.fill_null(pc.index_in(found.dictionary, value_set=t.keys), -1).to_numpy(zero_copy_only=False)[code] if len(code) else code
        g = t.g[first]
        # words without content never have such a key
        there = (same >= 0) & np.isin(g * self.width + same, self.content_codes)
        which = np.flatnonzero(~there)
        names, node, _ = _groups(g[which] * (len(found.dictionary) + 1) + code[which])
        return which, node, which[names]

    @cached_property
    def chunk_edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunk node, token node, count) of what chunks cover."""
        t = self.toks
        which, node, _ = self.fresh
        first = t.chunks[0][which]
        to, of = t.at(t.place[first], t.tok[first], t.tok[first] + t.chunk_names[1][which] - 1)
        src, dst = node[of].astype(np.int64), self.node[to]
        one, _, n = _groups(src * max(1, self.n_tokens) + dst)
        return src[one], dst[one], n.astype(np.int64)

    @cached_property
    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(g, label, first token, count) of classes."""
        ents = np.flatnonzero(self.label >= 0)
        code = self.g[ents] * 2 + self.label[ents]
        first, which, n = _groups(code)
        least = np.full(len(first), len(self.toks), np.int64)
        np.minimum.at(least, which, self.first[ents])
        return self.g[ents][first], self.label[ents][first], least, n.astype(np.int64)

    @cached_property
    def class_edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(token node, class) of entities."""
        ents = np.flatnonzero(self.label >= 0)
        return ents, _groups(self.g[ents] * 2 + self.label[ents])[1]

    @cached_property
    def all_g(self) -> np.ndarray:
        return np.concatenate([self.g, self.toks.g[self.toks.chunks[0][self.fresh[2]]], self.classes[0]])

    @cached_property
    def all_kinds(self) -> np.ndarray:
        return np.concatenate([self.kind, np.full(len(self.fresh[2]), 3, np.int8), np.full(len(self.classes[0]), 4, np.int8)])

    @cached_property
    def all_counts(self) -> np.ndarray:
        return np.concatenate([self.count, np.bincount(self.fresh[1], minlength=len(self.fresh[2])), self.classes[3]]).astype(np.int64)

    @cached_property
    def all_edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(src, dst, rel, count) of all edges, by positions among all nodes."""
        src, dst, rel, n = self.dep_edges
        a, b, m = self.chunk_edges
        x, y = self.class_edges
        base = self.n_tokens + len(self.fresh[2])
        return np.concatenate([src, a + self.n_tokens, x]), np.concatenate([dst, b, y + base]), np.concatenate([rel, np.full(len(a), 7), np.full(len(x), 8)]).astype(np.int8), np.concatenate([n, m, np.ones(len(x), np.int64)])

    def degree(self, edges: tuple, n: int) -> np.ndarray:
        """Distinct successors of n nodes."""
        pairs = np.unique(edges[0].astype(np.int64) * max(1, n) + edges[1])
        return np.bincount(pairs // max(1, n), minlength=n).astype(np.int64)

    @cached_property
    def node_id(self) -> np.ndarray:
        """From 0 in each graph, by first appearance; see textgraph.numbered()."""
        t = self.toks
        first = np.concatenate([self.first, t.chunks[0][self.fresh[2]], self.classes[2]])
        # tokens of a sentence, its classes, and, after the last sentence of the paragraph, chunks
        end = np.searchsorted(t.paragraph, np.arange(t.paragraph[-1] + 1), "right") - 1 if len(t) else first
        chunk = self.all_kinds == 3
        sentence = np.where(chunk, t.place[end][t.paragraph[first]] if len(t) else first, t.place[first])
        rank = (sentence * 3 + 2 * chunk + (self.all_kinds == 4)) * (len(t) + 1) + t.slot[first]
        if t.repeated:
            name = np.empty(len(first), np.int64)
            name[pc.sort_indices(pc.cast(self.all_names, pa.binary())).to_numpy()] = np.arange(len(first))
            order = np.lexsort((name, rank))
        else:
            order = np.argsort(rank)
        g = self.all_g[order]
        begin = np.searchsorted(g, np.arange(len(self.ids)))
        out = np.empty(len(order), np.int64)
        out[order] = np.arange(len(order)) - begin[g]
        return out

    @cached_property
    def all_names(self) -> pa.Array:
        chunk = self.toks.chunk_names[0].take(pa.array(self.fresh[2]))
        return pa.concat_arrays([self.names, chunk, _taken(tuple(CLASS[x][0] for x in LABELS), self.classes[1])])

    @cached_property
    def names(self) -> pa.Array:
        return self.toks.names.take(pa.array(self.first))

    @cached_property
    def texts(self) -> pa.Array:
        return self.toks.texts.take(pa.array(self.toks.code[self.first]))

    @cached_property
    def all_texts(self) -> pa.Array:
        return pa.concat_arrays([self.texts, self.toks.chunk_texts.take(pa.array(self.fresh[2])), _taken(tuple(CLASS[x][1] for x in LABELS), self.classes[1])])

    @cached_property
    def labels(self) -> pa.Array:
        return _taken((*(CLASS[x][0] for x in LABELS), None), np.where(self.label < 0, 2, self.label))

    @cached_property
    def all_labels(self) -> pa.Array:
        return pa.concat_arrays([self.labels, pa.nulls(len(self.fresh[2]), pa.string()), _taken(tuple(CLASS[x][2] for x in LABELS), self.classes[1])])

    @cached_property
    def pos(self) -> pa.Array:
        return _taken(POS, self.toks.pos[self.first])

    @cached_property
    def all_pos(self) -> pa.Array:
        return pa.concat_arrays([self.pos, _taken(("noun_chunk",), np.zeros(len(self.fresh[2]), np.int8)), _taken((rules.RDF_TYPE,), np.zeros(len(self.classes[0]), np.int8))])

    @cached_property
    def kept(self) -> np.ndarray:
        """Which of all nodes are exported: entities, lemmas that are no verbs, classes."""
        verb = np.concatenate([self.toks.pos[self.first] == VERB, np.zeros(len(self.all_kinds) - self.n_tokens, bool)])
        return (self.all_kinds == 4) | (self.all_kinds < 2) & ~verb

    @cached_property
    def all_lengths(self) -> np.ndarray:
        t = self.toks
        short = np.array([len(CLASS[x][2].split(" ")) for x in LABELS], np.int32)
        return np.concatenate([t.length[self.first], t.chunk_names[1][self.fresh[2]], short[self.classes[1]]]).astype(np.int32)

    @cached_property
    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(how many, tokens): the first tokens of what all nodes stand for, node by node in order; none of words without content and of classes."""
        t = self.toks
        content = np.flatnonzero(t.kind != 2)
        which, node, names = self.fresh
        nodes, at = np.concatenate([self.node[content], node + self.n_tokens]), np.concatenate([content, t.chunks[0][which]])
        order = np.argsort(nodes, kind="stable")
        return np.bincount(nodes, minlength=len(self.all_kinds)), at[order]

    @cached_property
    def loc(self) -> pa.Array:
        t, (n, at) = self.toks, self.places
        return _lists(n, pa.StructArray.from_arrays([pa.array(c[at]) for c in (t.para, t.sent, t.tok)], names=["para_id", "sent_id", "tok_i"]))


def by_graph(docs: DataFrame, make: Callable[[Tokens], pa.RecordBatch | list], schema: str, together: bool = True) -> DataFrame:
    """What make says of the tokens of documents (doc_id, text), block by block of whole graphs; rows of one doc_id come together unless it doesn't matter."""
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    if together:
        rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "text")
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, chars, kind = [], [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if chars >= BLOCK and (not together or i != ids[-1]):
                    yield pa.RecordBatch.from_arrays(make(Tokens(pa.array(ids, kind), texts)), names=names)
                    ids, texts, chars = [], [], 0
                ids.append(i)
                texts.append(text)
                chars += len(text)
        if ids:
            yield pa.RecordBatch.from_arrays(make(Tokens(pa.array(ids, kind), texts)), names=names)

    return rows.mapInArrow(run, schema)


def _id(docs: DataFrame) -> str:
    return "graph_id " + docs.schema["doc_id"].dataType.simpleString()


def _of(ids: pa.Array, g: np.ndarray) -> pa.Array:
    return ids.take(pa.array(g))


def tokens(docs: DataFrame, columns: tuple[str, ...] = ("para_id", "sent_id", "tok_i", "text", "lemma", "pos", "kind", "key", "ent_label", "head_i", "dep")) -> DataFrame:
    """textgraph.tokens(), of these columns."""
    numbers = {"para_id", "sent_id", "tok_i", "head_i"}
    made = {
        "para_id": lambda t: pa.array(t.para),
        "sent_id": lambda t: pa.array(t.sent),
        "tok_i": lambda t: pa.array(t.tok),
        "text": lambda t: t.texts.take(pa.array(t.code)),
        "lemma": lambda t: t.lowers.take(pa.array(t.code)),
        "pos": lambda t: _taken(POS, t.pos),
        "kind": lambda t: _taken(KINDS, t.kind),
        "key": lambda t: t.names,
        "ent_label": lambda t: _taken((*LABELS, None), np.where(t.kind == 0, t.spaced[t.code], 2)),
        "head_i": lambda t: pa.array(t.head),
        "dep": lambda t: _taken(DEPS, t.dep),
    }

    def make(t: Tokens) -> list:
        return [_of(t.ids, t.g), *(made[c](t) for c in columns)]

    return by_graph(docs, make, ", ".join([_id(docs), *(f"{c} {'int' if c in numbers else 'string'}" for c in columns)]), together=False)


NODE = "key string, kind string, pos string, text string, label string, count bigint, sub_obj boolean"
EDGE = "src string, dst string, rel string, kind string, prob double, count bigint"
PLACED = ", length int, loc array<struct<para_id:int,sent_id:int,tok_i:int>>, node_id bigint, neighbors bigint, annotated boolean"


def nodes(docs: DataFrame) -> DataFrame:
    """textgraph.token_nodes()."""

    def make(t: Tokens) -> list:
        x = Graph(t)
        return [_of(x.ids, x.g), x.names, _taken(KINDS, x.kind), x.pos, x.texts, x.labels, pa.array(x.count), pa.array(x.sub_obj)]

    return by_graph(docs, make, f"{_id(docs)}, {NODE}")


def _edge_rows(x: Graph, names: pa.Array, g: np.ndarray, src: np.ndarray, dst: np.ndarray, rel: np.ndarray, n: np.ndarray) -> list:
    kind = np.array([2] * 7 + [3, 4], np.int8)[rel]
    return [_of(x.ids, g[src]), names.take(pa.array(src)), names.take(pa.array(dst)), _taken(RELS, rel), _taken(KINDS, kind), pa.array(np.where(rel == 8, 0.0, 1.0)), pa.array(n)]


def edges(docs: DataFrame, exported: bool = False) -> DataFrame:
    """textgraph.dep_edges(), or those between exported nodes."""

    def make(t: Tokens) -> list:
        x = Graph(t)
        src, dst, rel, n = x.dep_edges
        if exported:
            keep = (x.kind < 2) & (t.pos[x.first] != VERB)
            src, dst, rel, n = (c[keep[src] & keep[dst]] for c in (src, dst, rel, n))
        return _edge_rows(x, x.names, x.g, src, dst, rel, n)

    return by_graph(docs, make, f"{_id(docs)}, {EDGE}")


def chunk_nodes(docs: DataFrame) -> DataFrame:
    """The nodes of textgraph.chunk_overlay()."""
    return lemma_nodes(docs, part=3)


def class_nodes(docs: DataFrame) -> DataFrame:
    """The nodes of textgraph.class_overlay()."""
    return lemma_nodes(docs, part=4)


def lemma_nodes(docs: DataFrame, placed: bool = False, part: int | None = None) -> DataFrame:
    """The nodes of textgraph.lemma_graph(), or of one kind; placed: those of textgraph.whole_graph()."""

    def make(t: Tokens) -> list:
        x = Graph(t)
        at = np.arange(len(x.all_kinds)) if part is None else np.flatnonzero(x.all_kinds == part)
        sub = np.concatenate([x.sub_obj, np.zeros(len(x.all_kinds) - x.n_tokens, bool)])
        out = [_of(x.ids, x.all_g[at]), x.all_names, _taken(KINDS, x.all_kinds), x.all_pos, x.all_texts, x.all_labels, pa.array(x.all_counts), pa.array(sub)]
        if placed:
            labelled = x.all_kinds == 0
            out += [pa.array(x.all_lengths), x.loc, pa.array(x.node_id), pa.array(x.degree(x.all_edges, len(x.all_kinds))), pa.array(labelled)]
        return out if part is None else [out[0], *(c.take(pa.array(at)) for c in out[1:])]

    return by_graph(docs, make, f"{_id(docs)}, {NODE}{PLACED if placed else ''}")


def lemma_edges(docs: DataFrame, part: int | None = None, last: bool = False) -> DataFrame:
    """The edges of textgraph.lemma_graph(), or of one kind (3: of chunks, 4: of classes); last: of all between two nodes, the last by kind (classes, dependencies, chunks) and relation."""
    late = np.argsort(np.argsort(RELS)) + np.array([len(RELS)] * 7 + [2 * len(RELS), 0])

    def make(t: Tokens) -> list:
        x = Graph(t)
        src, dst, rel, n = x.all_edges
        if part is not None:
            src, dst, rel, n = (c[rel == part + 4] for c in (src, dst, rel, n))
        if last:
            order = np.lexsort((-late[rel], dst, src))
            order = order[_groups(src[order].astype(np.int64) * max(1, len(x.all_kinds)) + dst[order])[0]]
            src, dst, rel, n = (c[order] for c in (src, dst, rel, n))
        return _edge_rows(x, x.all_names, x.all_g, src, dst, rel, n)

    return by_graph(docs, make, f"{_id(docs)}, {EDGE}")


def out_degree(docs: DataFrame) -> DataFrame:
    """textgraph.out_degree() of the nodes and dependencies of tokens."""

    def make(t: Tokens) -> list:
        x = Graph(t)
        return [_of(x.ids, x.g), x.names, pa.array(x.degree(x.dep_edges, x.n_tokens))]

    return by_graph(docs, make, f"{_id(docs)}, key string, neighbors bigint")


def token_offsets(docs: DataFrame) -> DataFrame:
    """textgraph.token_offsets()."""

    def make(t: Tokens) -> list:
        return [_of(t.ids, t.g), pa.array(t.para), pa.array(t.sent), pa.array(t.tok), pa.array(t.length), pa.array(t.offset)]

    return by_graph(docs, make, f"{_id(docs)}, para_id int, sent_id int, tok_i int, length int, offset int")


def unmerged(docs: DataFrame) -> DataFrame:
    """textgraph.unmerged()."""

    def make(t: Tokens) -> list:
        words = pc.split_pattern(t.texts, " ").take(pa.array(t.code))
        k, of = _spans(np.zeros(len(t), np.int64), t.length.astype(np.int64))
        return [_of(t.ids, t.g[of]), pa.array(t.para[of]), pa.array((t.offset[of] + k).astype(np.int32)), words.flatten(), _taken(POS, t.pos[of]), pa.array(t.sent[of]), pa.array(t.tok[of])]

    return by_graph(docs, make, f"{_id(docs)}, para_id int, word_i int, text string, pos string, sent_id int, tok_i int")


def _ordinals(groups: np.ndarray) -> np.ndarray:
    """Numbers from 0 within each run of equal values."""
    if not len(groups):
        return np.zeros(0, np.int32)
    new = np.concatenate([[True], groups[1:] != groups[:-1]])
    at = np.arange(len(groups))
    return (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.int32)


def entity_keys(docs: DataFrame) -> DataFrame:
    """textgraph.entity_keys()."""

    def make(t: Tokens) -> list:
        ents = np.flatnonzero(t.kind == 0)
        return [_of(t.ids, t.g[ents]), pa.array(t.para[ents]), pa.array(_ordinals(t.paragraph[ents])), t.keys.take(pa.array(t.key[ents])), pa.array(t.length[ents])]

    return by_graph(docs, make, f"{_id(docs)}, para_id int, ordinal int, key string, length int")


def chunk_offsets(docs: DataFrame) -> DataFrame:
    """textgraph.chunk_offsets()."""

    def make(t: Tokens) -> list:
        first, parts, whose = t.chunks
        words = np.bincount(whose, weights=t.length[parts], minlength=len(first)).astype(np.int32)
        ordinal, names = _ordinals(t.paragraph[first]), t.chunk_names[0]
        if t.repeated:  # each token at the place where a chunk starts
            at, of = t.at(t.place[first], t.tok[first], t.tok[first])
            return [_of(t.ids, t.g[at]), pa.array(t.para[at]), pa.array(ordinal[of]), names.take(pa.array(of)), pa.array(t.offset[at]), pa.array(words[of])]
        return [_of(t.ids, t.g[first]), pa.array(t.para[first]), pa.array(ordinal), names, pa.array(t.offset[first]), pa.array(words)]

    return by_graph(docs, make, f"{_id(docs)}, para_id int, ordinal int, key string, first_word int, words int")


def terms(docs: DataFrame) -> DataFrame:
    """paths.term_frequencies() of entities and lemmas that are no verbs."""

    def make(t: Tokens) -> list:
        x = Graph(t)
        at = np.flatnonzero(x.kept[: x.n_tokens])
        g, count, node_id = x.g[at], x.count[at], x.node_id[at]
        top = np.zeros(len(x.ids), np.int64)
        np.maximum.at(top, g, count)
        order = np.argsort(-node_id, kind="stable")
        code = t.code[x.first[at]]
        one = order[_groups((g.astype(np.int64) * (len(t.texts) + 1) + code)[order])[0]]
        scaled = np.rint(count[one] / top[g[one]] * 1000).astype(np.int32)
        return [_of(x.ids, g[one]), pc.replace_substring(t.texts.take(pa.array(code[one])), " ", "_"), pa.array(scaled)]

    return by_graph(docs, make, f"{_id(docs)}, term string, frequency int")


def _iris(x: Graph, at: np.ndarray, base: str) -> pa.Array:
    """IRIs of exported nodes."""
    names, own = x.all_names.take(pa.array(at)), pa.array(x.all_kinds[at] < 4)
    return pc.if_else(own, _joined(base + "entity/", pc.replace_substring_regex(names, "[ .]", "_")), names)


def property_nodes(docs: DataFrame, base: str = S.IRI_BASE) -> DataFrame:
    """The nodes of exchange.property_graph(), weighed by their counts."""

    def make(t: Tokens) -> list:
        x = Graph(t)
        at = np.flatnonzero(x.kept)
        take = lambda c: c.take(pa.array(at))
        return [_of(x.ids, x.all_g[at]), pa.array(x.node_id[at]), _iris(x, at, base), pa.array(x.all_counts[at].astype(np.float32)), _taken(KINDS, x.all_kinds[at]), take(x.all_names), take(x.all_labels), take(x.all_texts), take(x.all_pos), pa.array(x.all_lengths[at]), pa.array(x.all_counts[at])]

    return by_graph(docs, make, f"{_id(docs)}, id bigint, iri string, weight float, kind string, key string, label string, text string, pos string, length int, count bigint")


def property_edges(docs: DataFrame) -> DataFrame:
    """The edges of exchange.property_graph()."""

    def make(t: Tokens) -> list:
        x = Graph(t)
        src, dst, rel, n = x.all_edges
        src, dst, rel, n = (c[x.kept[src] & x.kept[dst]] for c in (src, dst, rel, n))
        kind = np.array([2] * 7 + [3, 4], np.int8)[rel]
        return [_of(x.ids, x.all_g[src]), pa.array(x.node_id[src]), pa.array(x.node_id[dst]), _taken(RELS, rel), pa.array(np.where(rel == 8, 0, 1).astype(np.float32)), _taken(KINDS, kind), pa.array(n)]

    return by_graph(docs, make, f"{_id(docs)}, src bigint, dst bigint, rel string, prob float, kind string, count bigint")


def rdf_triples(docs: DataFrame, base: str = S.IRI_BASE, lang: str = "en") -> DataFrame:
    """textgraph.rdf_triples() of the lemma graph, which has no inferred relations; distinct, as keys are."""

    def make(t: Tokens) -> list:
        x = Graph(t)
        named = np.flatnonzero(x.kept[: x.n_tokens])
        typed = np.flatnonzero(x.label >= 0)
        g, label = x.classes[:2]
        own, quoted = (lambda at: _iris(x, at, base)), (lambda c: _joined('"', c, f'"@{lang}'))
        of = lambda k: _taken(tuple(CLASS[c][k] for c in LABELS), label)
        preds = np.repeat(np.arange(4), [len(named), len(typed), len(g), len(g)])
        obj = [quoted(x.texts.take(pa.array(named))), _joined("<", x.labels.take(pa.array(typed)), ">"), quoted(of(2)), quoted(of(1))]
        return [_of(x.ids, np.concatenate([x.g[named], x.g[typed], g, g])), pa.concat_arrays([own(named), own(typed), of(0), of(0)]), _taken(("skos:prefLabel", "rdf:type", "skos:prefLabel", "skos:definition"), preds), pa.concat_arrays(obj)]

    return by_graph(docs, make, f"{_id(docs)}, subj string, pred string, obj string")


def _related(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entity, verb, next entity), as tokens: the first verb after an entity, where it comes before the next one of the sentence."""
    ents, verbs = np.flatnonzero(t.kind == 0), np.flatnonzero(t.pos == VERB)
    one, after = ents[:-1], ents[1:]
    verb = np.concatenate([verbs, [len(t)]])[np.searchsorted(verbs, one, "right")]
    met = (t.place[one] == t.place[after]) & (verb < after)
    return one[met], verb[met], after[met]


def verb_relations(docs: DataFrame, loss: float = 0.002) -> DataFrame:
    """backends.VerbRelations."""

    def make(t: Tokens) -> list:
        one, verb, after = _related(t)
        word = lambda c, at: c.take(pa.array(t.code[at]))
        return [_of(t.ids, t.g[one]), pa.array(t.para[one]), pa.array(t.sent[one]), word(t.texts, one), word(t.lowers, verb), word(t.texts, after), pa.array(1 - loss * (t.tok[after] - t.tok[one]))]

    return by_graph(docs, make, f"{_id(docs)}, para_id int, sent_id int, head string, rel string, tail string, prob double")


def matched_relations(docs: DataFrame, min_prob: float, loss: float = 0.002) -> DataFrame:
    """Verb relations as linking.matched() gives them, with the texts (from, to) of the nodes they join."""

    def make(t: Tokens) -> list:
        x = Graph(t)
        one, verb, after = _related(t)
        prob = 1 - loss * (t.tok[after] - t.tok[one])
        sure = prob >= min_prob
        one, verb, after, prob = one[sure], verb[sure], after[sure], prob[sure]
        # the last token of a text in its sentence
        near = np.flatnonzero(np.isin(t.place, t.place[one]))
        said = t.place * (len(t.texts) + 1) + t.code
        order = near[np.argsort(said[near], kind="stable")]
        src, dst = (x.node[order[np.searchsorted(said[order], said[at], "right") - 1]] if len(at) else at for at in (one, after))
        apart = src != dst
        src, dst, verb, prob = src[apart], dst[apart], verb[apart], prob[apart]
        take = lambda c, at: c.take(pa.array(at))
        return [_of(x.ids, x.g[src]), take(x.names, src), take(x.names, dst), t.lowers.take(pa.array(t.code[verb])), pa.array(prob), take(x.texts, src), take(x.texts, dst)]

    return by_graph(docs, make, f"{_id(docs)}, src string, dst string, rel string, prob double, from string, to string")


def entities(docs: DataFrame) -> DataFrame:
    """The entity nodes of nodes()."""

    def make(t: Tokens) -> list:
        x = Graph(t)
        at = np.flatnonzero(x.kind == 0)
        first = x.first[at]
        return [_of(x.ids, x.g[at]), t.keys.take(pa.array(t.key[first])), _taken(KINDS, x.kind[at]), _taken(POS, t.pos[first]), t.texts.take(pa.array(t.code[first])), x.labels.take(pa.array(at)), pa.array(x.count[at]), pa.array(x.sub_obj[at])]

    return by_graph(docs, make, f"{_id(docs)}, {NODE}")


def near_entities(docs: DataFrame, max_nodes: int) -> DataFrame:
    """paths.near_pairs() of textgraph.entity_pairs()."""

    def make(t: Tokens) -> list:
        x = Graph(t)
        ents = np.flatnonzero(t.kind == 0)
        wide = x.n_tokens + 1
        first, _, times = _groups(t.paragraph[ents] * wide + x.node[ents])
        one = ents[first]  # by paragraph, each of its entities
        para = t.paragraph[one]
        several = np.isin(para, para[1:][para[1:] == para[:-1]])
        one, para, times = one[several], para[several], times[several]
        if t.repeated:
            to, of = t.at(t.place, t.head, t.head)
        else:
            of = np.arange(len(t))
            to = of + t.head - t.tok
        met = np.isin(t.paragraph[of], para) & (x.node[of] != x.node[to])
        of, to = of[met], to[met]
        order = np.argsort(t.paragraph[of], kind="stable")
        of, to = of[order], to[order]
        lo, hi = (np.searchsorted(t.paragraph[of], np.unique(para), side) for side in ("left", "right"))
        rows = []
        for p, a, b in zip(np.unique(para).tolist(), lo.tolist(), hi.tolist()):
            links: dict[int, set[int]] = {}
            for i, j in zip(x.node[of[a:b]].tolist(), x.node[to[a:b]].tolist()):
                links.setdefault(i, set()).add(j)
                links.setdefault(j, set()).add(i)
            k = np.arange(*np.searchsorted(para, [p, p + 1]))
            asked = dict(zip(x.node[one[k]].tolist(), k.tolist()))
            for i, at in asked.items():
                reach = paths.distances(links, i, max_nodes - 1)
                rows += [(at, asked[j], reach[j]) for j in (asked.keys() & reach.keys() if len(asked) < len(reach) else [j for j in reach if j in asked]) if j != i]
        src, dst, hops = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
        name = lambda k: t.keys.take(pa.array(t.key[one[k]]))
        return [_of(t.ids, t.g[one[src]]), pa.array(t.para[one[src]]), name(src), name(dst), pa.array(times[src] * times[dst]), pa.array(hops.astype(np.int32))]

    return by_graph(docs, make, f"{_id(docs)}, para_id int, src string, dst string, n bigint, hops int")


def pagerank(docs: DataFrame, alpha: float) -> DataFrame:
    """rank.pagerank() of nodes and dependencies of tokens."""

    def make(t: Tokens) -> list:
        x = Graph(t)
        src, dst, _, n = x.dep_edges
        return [_of(x.ids, x.g), x.names, pa.array(rank.power_iterations(x.g, len(x.ids), src, dst, n.astype(float), alpha))]

    return by_graph(docs, make, f"{_id(docs)}, key string, pagerank double")


def phrases(docs: DataFrame, alpha: float) -> DataFrame:
    """rank.phrases() of textgraph.whole_graph()."""

    def make(t: Tokens) -> list:
        x = Graph(t)
        src, dst, _, n = x.all_edges
        g, kind, m = x.all_g, x.all_kinds, len(x.all_kinds)
        ranks = np.round(rank.power_iterations(g, len(x.ids), src, dst, n.astype(float), alpha), rank.PLACES)
        used = np.where((kind == 4) | (np.concatenate([t.pos[x.first], np.zeros(m - x.n_tokens, np.int8)]) == VERB), 0, x.all_counts)
        sub = np.concatenate([x.sub_obj, np.zeros(m - x.n_tokens, bool)])
        weight = rank.restacked(g, len(x.ids), kind == 0, used, x.degree(x.all_edges, m), sub, ranks)
        order = np.lexsort((x.node_id, -weight, g))
        order = order[weight[order] > 0]
        place = _ordinals(g[order]) + np.int32(1)
        take = lambda c: c.take(pa.array(order))
        return [_of(x.ids, g[order]), take(x.all_names), pa.array(x.node_id[order]), take(x.all_texts), take(x.all_pos), take(x.all_labels), pa.array(x.all_counts[order]), pa.array(weight[order]), pa.array(place)]

    return by_graph(docs, make, f"{_id(docs)}, key string, node_id bigint, text string, pos string, label string, count bigint, weight double, rank int")


def _escaped(c: pa.Array) -> pa.Array:
    """Texts as they stand between the quotes of JSON."""
    odd = pc.match_substring_regex(c, r'["\\\x00-\x1f]')
    if not pc.any(odd).as_py():
        return c
    return pc.replace_with_mask(c, odd, pa.array([json.dumps(v, ensure_ascii=False)[1:-1] for v in c.filter(odd).to_pylist()], pa.string()))


def nodelink(docs: DataFrame) -> DataFrame:
    """nodelink.dump() of textgraph.whole_graph(); links in order of the nodes they join."""

    def make(t: Tokens) -> list:
        x = Graph(t)
        names, texts = _escaped(x.all_names), _escaped(x.all_texts)
        kinds, node_id, t_or_f = x.all_kinds, x.node_id, ("false", "true")
        shown = pc.if_else(pa.array(kinds == 2), "", pc.if_else(pa.array(kinds == 4), x.all_labels, texts))
        iri = pc.if_else(pa.array(kinds == 4), names, pc.if_else(pa.array(kinds == 0), x.all_labels, pa.scalar(None, pa.string())))
        iri = pc.fill_null(_joined(',"iri":"', iri, '"'), "")
        n, at = x.places
        spot = _joined('{"para_id":', _text(t.para[at]), ',"sent_id":', _text(t.sent[at]), ',"tok_i":', _text(t.tok[at]), "}")
        loc = pc.binary_join(_lists(n, spot), ",")
        sub = np.concatenate([x.sub_obj, np.zeros(len(kinds) - x.n_tokens, bool)])
        count = _text(x.all_counts)
        node = _joined('{"lemma":"', names, '","count":', count, ',"weight":0.0,"kind":"', _taken(KINDS, kinds), '","label":"', shown, '","name":"', texts, '","subobj":', _taken(t_or_f, sub.astype(np.int8)), ',"pos":"', x.all_pos, '","loc":[', loc, '],"length":', _text(x.all_lengths), ',"hood":', _text(x.degree(x.all_edges, len(kinds))), ',"anno":', _taken(t_or_f, (kinds == 0).astype(np.int8)), iri, "}")
        src, dst, rel, m = x.all_edges
        order = np.lexsort((rel, node_id[dst], node_id[src], x.all_g[src]))
        src, dst, rel, m = (c[order] for c in (src, dst, rel, m))
        kind, a, b, m = np.array([0] * 7 + [1, 2], np.int8)[rel], _text(node_id[src]), _text(node_id[dst]), _text(m)
        title, prob = _taken(RELS, rel), _taken(("1.0", "0.0"), (rel == 8).astype(np.int8))
        link = _joined('{"kind":"', _taken(("dep", "chu", "iri"), kind), '","title":"', title, '","lemma":"', a, ".", b, ".", title, ".", _taken(("0", "1", "4"), kind), '","weight":', m, '.0,"prob":', prob, ',"count":', m, ',"source":', a, ',"target":', b, "}")
        by_graph_ = lambda g, c: pc.binary_join(_lists(np.bincount(g, minlength=len(x.ids)), c), ",")
        nodes_of = by_graph_(x.all_g, node.take(pa.array(np.lexsort((node_id, x.all_g)))))
        whole = _joined('{"directed":true,"multigraph":true,"nodes":[', nodes_of, '],"links":[', by_graph_(x.all_g[src], link), "]}")
        some = pa.array(np.bincount(x.all_g, minlength=len(x.ids)) > 0)  # a text without tokens is no graph
        return [x.ids.filter(some), whole.filter(some)]

    return by_graph(docs, make, f"{_id(docs)}, json string")
