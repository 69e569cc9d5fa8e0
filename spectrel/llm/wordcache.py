"""Encoding of whole texts by a ``tokenizers`` file through caches of the chunks between blanks.

Two rules hold for the tokenizer files used here, and each gives chunks whose ids do not depend on their neighbours:

* ``dropped``: white space separates pre-tokens and is dropped, so a text's ids are those of its chunks between blanks
  and line ends, in order.
* ``leading``: a pre-token takes one leading blank, so a text may be cut before every blank that has no white space
  before it.

Added tokens contain no white space, so they stay inside one chunk under either rule.

``takes_leading_blank`` tells from a file's normaliser and splitting rule which of the two holds, and refuses other files.

A chunk of letters, or of letters and one mark of ``MARKS``, is one pre-token, or that and the mark's, if the letters are still
letters once normalised (a few become a letter and a combining mark, which the mark after it joins). Letter chunks that are
new are encoded many at a time in one text, whose ids are cut where a pre-token ends (``dropped``: the piece that carries
the end-of-word suffix) or begins (``leading``: the piece that carries the blank). A chunk of letters has one such piece at most,
as it is one pre-token, so if there are as many as chunks, each has one and the cuts are right; else (a letter may be
unknown) these chunks are encoded one by one, as all other chunks are.

A cache holds about ``CACHE_CHUNKS`` chunks and is emptied when full; results do not depend on it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_CHUNKS = 1_200_000
#: Longer chunks are encoded each time, so that the cache's memory is bounded too.
LONGEST = 100
MARKS = ".,!?;:"
#: Normaliser, splitter and end-of-word suffix of the two kinds of files.
LEADING = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, None)
DROPPED = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "</w>",
)
#: A blank after other white space (for Arrow's expressions), and the blanks before which a text may be cut.
_BEFORE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] "
_CUT = re.compile(r"(?<!\s) ")


def takes_leading_blank(data: bytes) -> bool:
    """Whether a tokenizer file follows the rule ``leading`` (else ``dropped``); ValueError if it follows neither."""
    found = json.loads(data)
    if (found.get("model") or {}).get("type") == "BPE":
        rules = found.get("normalizer"), found.get("pre_tokenizer"), found["model"].get("end_of_word_suffix")
        if rules in (LEADING, DROPPED):
            return rules == LEADING
    raise ValueError("chunks between blanks are not known to be independent under this tokenizer's rules")


def load(data: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(data)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Chunks:
    """Encoder of one tokenizer file; ``leading`` selects the rule. A chunk's value is its packed ids, or with ``counts_only`` their number."""

    def __init__(self, data: bytes, leading: bool, counts_only: bool = False):
        self.tokenizer, self.leading, self.counts_only = load(data), leading, counts_only
        self.normalizer = self.tokenizer.normalizer
        self.first: dict = {}
        self.rest: dict = {}
        self.stems: dict = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.edge = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for piece, i in vocabulary.items():
            self.edge[i] = piece.startswith("Ġ") if leading else piece.endswith("</w>")
        self.marks = dict(zip(MARKS, self._each(list(MARKS)), strict=True))

    def _value(self, ids) -> bytes | int:
        return len(ids) if self.counts_only else np.asarray(ids, dtype="<u4").tobytes()

    def _each(self, chunks: list[str]) -> list:
        return [self._value(e.ids) for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _letters(self, stems: list[str]) -> list:
        """Values of chunks of letters."""
        blank = " " if self.leading else ""
        ids = np.asarray(self.tokenizer.encode(blank + " ".join(stems), add_special_tokens=False).ids, dtype="<u4")
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(stems):
            return self._each([blank + s for s in stems])
        cuts = np.append(at, len(ids)) if self.leading else np.append(0, at + 1)
        if self.counts_only:
            return np.diff(cuts).tolist()
        raw, cuts = ids.tobytes(), (cuts * 4).tolist()
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _plain(self, stem: str) -> bool:
        """Whether these are letters, and still are once normalised."""
        return stem.isalpha() and (stem.isascii() or self.normalizer is None or self.normalizer.normalize_str(stem).isalpha())

    def _fill(self, cache: dict, wanted: list[str], blank: str) -> dict:
        """Values of the wanted chunks. All but long ones go into the cache."""
        stems, out, parts, others = self.stems, {}, [], []
        new = {}
        for chunk in wanted:
            mark = chunk[-1:] if chunk[-1:] in self.marks else ""
            stem = chunk[:-1] if mark else chunk
            if len(chunk) <= LONGEST and (blank or not self.leading) and self._plain(stem):
                parts.append((chunk, stem, mark))
                if stem not in stems:
                    new[stem] = None
            else:
                others.append(chunk)
        missing = list(new)
        for at in range(0, len(missing), 2000):
            part = missing[at : at + 2000]
            stems.update(zip(part, self._letters(part), strict=True))
        for chunk, stem, mark in parts:
            out[chunk] = stems[stem] + self.marks[mark] if mark else stems[stem]
        for at in range(0, len(others), 5000):
            part = others[at : at + 5000]
            out.update(zip(part, self._each([blank + c for c in part]), strict=True))
        cache.update((c, v) for c, v in out.items() if len(c) <= LONGEST)
        return out

    def _values(self, cache: dict, chunks: list[str], blank: str) -> list:
        """Values of distinct chunks."""
        if len(cache) > CACHE_CHUNKS:
            cache.clear()
        if len(self.stems) > CACHE_CHUNKS:
            self.stems.clear()
        found = list(map(cache.get, chunks))
        if None in found:
            new = self._fill(cache, [c for c, v in zip(chunks, found, strict=True) if v is None], blank)
            found = [new[c] if v is None else v for c, v in zip(chunks, found, strict=True)]
        return found

    def _split(self, texts: pa.Array) -> pa.ListArray:
        """The chunks of each text; the blanks between them are left out."""
        if not self.leading:
            texts = pc.replace_substring(texts, "\n", " ")
            if not pc.any(pc.match_substring(texts, "<|")).as_py():  # the names of added tokens are told apart by case
                texts = pc.ascii_lower(texts)
            return pc.split_pattern(texts, " ")
        odd = pc.match_substring_regex(texts, _BEFORE)
        if not pc.any(odd).as_py():
            return pc.split_pattern(texts, " ")
        return pa.array([_CUT.split(t) if x else t.split(" ") for t, x in zip(texts.to_pylist(), odd.to_pylist(), strict=True)], pa.list_(pa.string()))

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray | None, np.ndarray]:
        """All ids, one text after the other (none with ``counts_only``), and the number of ids of each text. Null counts as empty."""
        texts = texts.fill_null("")
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        lists = self._split(texts)
        coded = lists.flatten().dictionary_encode()
        at = np.asarray(lists.offsets)[: len(texts) + 1].astype(np.int64)
        at -= at[0]
        index = np.asarray(coded.indices).astype(np.int64)
        values = self._values(self.rest, coded.dictionary.to_pylist(), " " if self.leading else "")
        if self.leading:
            heads = lists.flatten().take(pa.array(at[:-1])).dictionary_encode()
            index[at[:-1]] = len(values) + np.asarray(heads.indices)
            values = values + self._values(self.first, heads.dictionary.to_pylist(), "")
        if self.counts_only:
            return None, np.add.reduceat(np.array(values, np.int64)[index], at[:-1])
        flat = np.frombuffer(b"".join(values), "<u4")
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        starts = np.cumsum(sizes) - sizes
        each = sizes[index]
        ends = np.cumsum(each)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[index] - (ends - each), each)]
        return ids, np.add.reduceat(each, at[:-1])

    def encode(self, texts: list[str]) -> list:
        """Packed ids of each text, or with ``counts_only`` their number."""
        ids, n = self.encode_array(pa.array(texts, pa.string()))
        if ids is None:
            return n.tolist()
        ends = np.cumsum(n).tolist()
        return [ids[e - k : e].tobytes() for e, k in zip(ends, n.tolist(), strict=True)]


def gathered(batches, text: str, size: int = 4_000_000):
    """Record batches put together to about ``size`` bytes of text, so that chunks repeat more often within one."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.column(text).nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
    if held and (rows := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield rows[0]


_LOADED: dict = {}


def loaded(data: bytes, leading: bool, counts_only: bool = False) -> Chunks:
    """The encoder of this worker, kept between tasks."""
    key = (hashlib.sha256(data).digest(), leading, counts_only)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Chunks(data, leading, counts_only)
    return _LOADED[key]
