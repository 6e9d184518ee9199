"""SentencePiece encoding and decoding of merge-type models, without running merges over the text.

A sequence of pieces is the model's own encoding when each piece encodes to itself and each two neighbours,
joined and merged anew, fall apart at the same place. So a part of the text is encoded by taking the longest
piece at each place (Aho-Corasick), trying shorter prefixes where the neighbour check fails, and stepping back
where nothing fits; a field of failed places keeps it from trying one twice.

White space starts pieces and never stands inside one, so the text falls into words that can be encoded alone.
Characters that no piece holds are barriers too. The words' ids are remembered within bounds.

Defined cases: a null text is empty; an empty text gives the end id only. Unknown characters become byte pieces.
Literal marks of control pieces in a text are ordinary text. Repeated rows are answered as often as they occur.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import texts_of

SPACE = "▁"
REMEMBERED_WORDS, REMEMBERED_PAIRS, LONGEST_REMEMBERED = 400_000, 1_000_000, 64

_models: dict[str, "PieceModel"] = {}


def _one_mark_a_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("millrace_byte", _one_mark_a_byte)


class PieceModel:
    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec, trained = proto.normalizer_spec, proto.trainer_spec
        if trained.model_type != 2 or not trained.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError(f"{path}: only merge-type models with byte fallback, a dummy prefix and no normalisation")
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.surface: list[bytes] = []
        self.byte_ids: list[int] = [0] * 256
        self.end_id = trained.eos_id
        for i, piece in enumerate(proto.pieces):
            text = piece.piece
            if piece.type == 1:
                self.ids[text], self.score[text] = i, piece.score
                self.surface.append(text.replace(SPACE, " ").encode())
            elif piece.type == 6:
                value = int(text[3:5], 16)
                self.byte_ids[value] = i
                self.surface.append(bytes([value]))
            elif piece.type == 3:
                self.surface.append(b"")
            elif piece.type == 2:
                self.surface.append(trained.unk_surface.encode())
            else:
                raise ValueError(f"{path}: a piece of type {piece.type}")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError(f"{path}: white space inside a piece")
        self.unknown = {i for i, p in enumerate(proto.pieces) if p.type == 2}
        self.bytes = set(self.byte_ids)
        # Characters are the atoms. One that is no piece by itself may still be part of a longer piece.
        self.pieces = list(self.ids)
        atoms = sorted({c for p in self.pieces for c in p} - self.ids.keys())
        self.pieces += atoms
        self.number = {p: n for n, p in enumerate(self.pieces)}
        self.shown = [str(self.ids[p]) if p in self.ids else " ".join(str(self.byte_ids[b]) for b in p.encode()) for p in self.pieces]
        reached = [p for p in self.pieces if len(p) == 1 or self.merged(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in reached:
            self.automaton.add_word(p, (self.number[p], len(p) - 1))
        self.automaton.make_automaton()
        known = set(reached)
        self.shorter: list[int] = [-1] * len(self.pieces)
        for p in reached:
            self.shorter[self.number[p]] = next((self.number[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in known), -1)
        self.length = [len(p) for p in self.pieces]
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, str] = {}
        self.after_blank: dict[str, str] = {}  # as words, without the white space in front; a line end stands alone
        self.surface_of = {str(i): b for i, b in enumerate(self.surface)}
        chars = "".join(sorted({c for p in self.pieces for c in p} - {SPACE}))
        inside = re.escape(chars)
        self.parts = re.compile(f"{SPACE}*[{inside}]+|{SPACE}+|[^{inside}{SPACE}]")
        # Two characters that stand side by side in no piece are never merged across: words fall apart there.
        self.beside = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}

    def merged(self, text: str) -> list[str]:
        """Plain merging, best score first and leftmost among equals: the definition. Used on pieces and pairs of pieces only."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether the two pieces, joined and merged anew, are these two again."""
        a, b = self.pieces[left], self.pieces[right]
        known = a[-1] + b[0] not in self.beside or self.merged(a + b) == [a, b]
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        self.pairs[left << 20 | right] = known
        return known

    def backtrack(self, word: str) -> list[int]:
        """Numbers of the pieces of a part without unknown characters."""
        n, length, shorter, pairs = len(word), self.length, self.shorter, self.pairs
        longest = [-1] * (n + 1)
        for end, (number, before) in self.automaton.iter(word):  # by rising ends: the last match of a start is its longest
            longest[end - before] = number
        failed, found, place, candidate, last = bytearray(n + 1), [], 0, longest[0], -1
        while place < n:
            while candidate >= 0:
                end = place + length[candidate]
                if not failed[end]:
                    if last < 0:
                        break
                    fits = pairs.get(last << 20 | candidate)
                    if self.fits(last, candidate) if fits is None else fits:
                        break
                candidate = shorter[candidate]
            if candidate >= 0:
                found.append(candidate)
                last, place = candidate, end
                candidate = longest[place]
            else:
                if not found:
                    raise AssertionError(f"no encoding of {word!r}")
                failed[place] = 1
                candidate = found.pop()
                place -= length[candidate]
                last = found[-1] if found else -1
        return found

    def word(self, part: str) -> str:
        """Ids of a part in decimal, joined by blanks. Plain strings keep the memory of words small and out of the garbage collector's way."""
        beside, words = self.beside, self.words
        if not beside.issuperset(map(add, part, part[1:])):
            cuts = [k for k in range(1, len(part)) if part[k - 1 : k + 1] not in beside]
            made = " ".join([words.get(x) or self.word(x) for x in map(part.__getitem__, map(slice, [0, *cuts], [*cuts, None]))])
        elif part[0] in self.number:
            made = " ".join([self.shown[k] for k in self.backtrack(part)])
        else:
            made = " ".join([str(self.byte_ids[b]) for b in part.encode()])
        if len(part) <= LONGEST_REMEMBERED:
            if len(words) >= REMEMBERED_WORDS:
                words.clear()
            words[part] = made
        return made

    def _after_blank(self, part: str) -> str:
        words = self.words
        made = " ".join([words.get(p) or self.word(p) for p in self.parts.findall(part if part[:1] == "\n" else SPACE + part)])
        if len(part) <= LONGEST_REMEMBERED:
            if len(self.after_blank) >= REMEMBERED_WORDS:
                self.after_blank.clear()
            self.after_blank[part] = made
        return made

    def encode_shown(self, text: str, end: bool = True) -> str:
        """The ids in decimal, joined by blanks."""
        found = []
        if text and (text[0] == " " or SPACE in text or "  " in text or " \n" in text):
            words = self.words
            found = [words.get(p) or self.word(p) for p in self.parts.findall(SPACE + text.replace(" ", SPACE))]
        elif text:  # single blanks only
            words = self.after_blank
            found = [words.get(p) or self._after_blank(p) for p in text.replace("\n", " \n").split(" ")]
        if end:
            found.append(str(self.end_id))
        return " ".join(found)

    def encode(self, text: str, end: bool = True) -> list[int]:
        return [int(i) for i in self.encode_shown(text, end).split()]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: byte pieces are gathered to characters, the dummy prefix goes, control pieces are empty."""
        return self.decode_shown(list(map(str, ids)))

    def decode_shown(self, ids: list[str]) -> str:
        """As ``decode``, of ids in decimal."""
        raw = b"".join(map(self.surface_of.__getitem__, ids))
        if raw[:1] == b" ":
            first = int(next(i for i in ids if self.surface_of[i]))
            if first not in self.unknown and first not in self.bytes:
                raw = raw[1:]
        return raw.decode("utf-8", "millrace_byte")


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode_table(docs: DataFrame, path: str, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` of every text. The model file lies at ``path`` on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(path)
        for batch in batches:
            texts = texts_of(batch)
            for i in range(0, len(texts), 512):
                ids = [coder.encode(t, end) for t in texts[i : i + 512]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(ids)), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_table(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``text`` of every list of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(path)
        for batch in batches:
            texts = [coder.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digest_table(docs: DataFrame, path: str, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text; per document the number of ids and the digests of ids and decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder: PieceModel = model(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in texts_of(batch):
                shown = coder.encode_shown(text, end)
                ids = shown.split(" ") if shown else []
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(shown.encode()).hexdigest())
                of_text.append(hashlib.sha256(coder.decode_shown(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
