"""SentencePiece encoding and decoding: Aho-Corasick automaton and a single pass, Viterbi or in merge order.

The automaton over all ordinary pieces is run once over the text; at each end
position its state and output links name every piece that ends there, longest
first, and each relaxes the best score of that position. Scores are the
model's own; a character that no piece covers costs the lowest score less ten
and is spelt in byte pieces. Of equal paths the one whose last piece starts
first wins. That is the library's segmentation for unigram models. For BPE
models, where a score is a merge's rank, `Bpe` makes the same pass with another
choice: the piece that ends a position's prefix is the one that merging leaves
beside the piece before it. Ids equal the library's. If no piece joins text across a word boundary (checked when the
vocabulary is read), a path is made of the words' paths, so words
are solved once and remembered, within a bound. Characters of no piece, such as line ends, part a word for `Bpe`: merges never cross them. State is held in flat arrays of
8 (BPE) or 16 bytes a character, so one long text without spaces is bounded too.

Defined results: null and empty texts have no pieces; a U+2581 in a text
decodes to a space, as in the library; repeated ids each give a row; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BINARY, LONG, schema, table
from .tokens import pack

#: The library's mark for a space, and what an unknown character costs below the lowest score.
SPACE, UNKNOWN_COST = "\u2581", 10.0


class Viterbi:
    def __init__(self, path: str, keep: int = 250_000):
        import ahocorasick
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        ordinary = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.value = {i: b for b, i in self.bytes.items()}
        self.hidden = {i for i in range(n) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        scores = [sp.get_score(i) for i in ordinary]
        self.unknown_score = min(scores) - UNKNOWN_COST
        self.automaton = ahocorasick.Automaton()
        for i, s in zip(ordinary, scores, strict=True):
            self.automaton.add_word(self.text[i], (len(self.text[i]), s, i))
        self.automaton.make_automaton()
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", self.text[i]) for i in ordinary)
        self.keep, self.cache, self.old = keep, {}, {}
        # what an id decodes to; an ASCII byte is a character whatever is beside it
        shown = lambda i: "" if i in self.hidden else " \u2047 " if i == self.unknown else self.text[i]
        self.shown = [chr(self.value[i]) if i in self.value else shown(i) for i in range(n)]
        self.high = np.array([self.value.get(i, 0) > 127 for i in range(n)])

    def _spell(self, char: str) -> list[int]:
        data = char.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in data] if self.bytes else [self.unknown]

    def path(self, text: str) -> array:
        """Best segmentation of a normalised text. A character costs 16 bytes of state."""
        n = len(text)
        best, sizes, ends = array("d", bytes(8 * (n + 1))), array("i", bytes(4 * (n + 1))), array("i", bytes(4 * (n + 1)))
        matches = self.automaton.iter(text)
        coming = next(matches, None)
        for end in range(1, n + 1):
            single, top, came, last = False, None, 0, -1
            while coming is not None and coming[0] == end - 1:
                size, score, piece = coming[1]
                single |= size == 1
                reached = best[end - size] + score
                if top is None or reached > top:
                    top, came, last = reached, size, piece
                coming = next(matches, None)
            if not single and (top is None or best[end - 1] + self.unknown_score > top):
                top, came, last = best[end - 1] + self.unknown_score, 1, -1
            best[end], sizes[end], ends[end] = top, came, last
        return self._walk(text, sizes, ends)

    def _walk(self, text: str, sizes: array, ends: array) -> array:
        """Ids on the way back from the end; -1 ends a character that is no piece."""
        out, at = array("I"), len(text)
        while at:
            if ends[at] >= 0:
                out.append(ends[at])
            else:
                out.extend(reversed(self._spell(text[at - sizes[at] : at])))
            at -= sizes[at]
        out.reverse()
        return out

    def encode(self, text: str | None) -> bytes:
        """Little-endian u32 piece ids of a text, which is normalised as the model says."""
        if not text:
            return b""
        normal = self.sp.normalize(text)
        if not self.by_word:
            return pack(self.path(normal))
        words = self._words(normal)
        out = list(map(self.cache.get, words))
        if None in out:
            out = [self._solved(word) if ids is None else ids for word, ids in zip(words, out, strict=True)]
        return b"".join(out)

    def _solved(self, word: str) -> bytes:
        """Ids of a word, remembered if it is short and has no parts."""
        ids = self.cache.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                parts = self._parts(word)
                if len(parts) > 1:
                    return b"".join(map(self._solved, parts))
                ids = pack(self.path(word))
            if len(word) <= 64:
                self.cache[word] = ids
                if len(self.cache) > self.keep:
                    self.old, self.cache = self.cache, {}
        return ids

    def _parts(self, word: str) -> list[str]:
        """Parts of a word whose paths make up its own."""
        return [word]

    @staticmethod
    def _words(normal: str) -> list[str]:
        """Cut before every run of space marks."""
        if SPACE * 2 not in normal:
            first, *rest = normal.split(SPACE)
            words = [SPACE + w for w in rest]
            return [first, *words] if first else words
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+$", normal)

    def decode(self, ids: bytes) -> str:
        found = np.frombuffer(ids, "<u4")
        if self.high[found].any():
            text = self._decoded(found.tolist())
        else:
            text = "".join(map(self.shown.__getitem__, found.tolist()))
        text = text.replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def _decoded(self, ids: list[int]) -> str:
        """Text of ids, with runs of bytes decoded together."""
        out, raw = [], bytearray()
        for i in ids:
            if (b := self.value.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.shown[i])
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out)


class Bpe(Viterbi):
    """Segmentation by merges: of all neighbours that make a piece, those with the best score are joined first, leftmost first.

    A sequence of pieces is what merging leaves of its text just if that holds for each two neighbours: the first merge across
    a border would come in the two alone as well, since all before it are within pieces. So each prefix has one last piece that
    fits the one before it, and a single pass finds it. What fits is remembered for up to `pairs` pairs.
    """

    def __init__(self, path: str, keep: int = 250_000, pairs: int = 500_000):
        super().__init__(path, keep)
        if any(self.sp.is_unused(i) for i in range(len(self.text))):
            raise ValueError("BPE models with unused pieces are not supported")
        self.scores = {text: score for text, (_, score, _) in self.automaton.items()}
        self.most, self.fits = pairs, {}
        own = "".join(re.escape(c) for c in sorted({c for text in self.scores for c in text}))
        self.apart = re.compile(f"([^{own}]+)")
        self.last_merges: dict[str, tuple[str, str] | None] = {}

    def _parts(self, word: str) -> list[str]:
        return [part for part in self.apart.split(word) if part]

    def merge(self, text: str, least: int = 1) -> list[str]:
        """Merges of a short text, one after the other, until `least` parts are left or none can be joined."""
        parts = list(text)
        while len(parts) > least:
            best, at = None, 0
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _last_merge(self, text: str) -> tuple[str, str] | None:
        """The two parts that a piece's last merge joins; None if merging does not leave the piece, or comes to it by a worse merge."""
        if text not in self.last_merges:
            parts = self.merge(text, 2)
            own = self.scores[text]
            good = len(parts) == 2 and all(len(p) == 1 or self.scores[p] > own and self._last_merge(p) for p in parts)
            self.last_merges[text] = tuple(parts) if good else None
        return self.last_merges[text]

    def _apart(self, left: str, right: str) -> bool | None:
        """Whether two pieces stay apart. The merges that made them are undone, last ones first; at each step what is on both
        sides of the border must not be a piece that would have come before the merge undone: by a better score, or an equal one
        further left. None if that cannot tell."""
        scores, known = self.scores, self.last_merges
        limit, at_left = None, False
        while True:
            across = scores.get(left + right)
            if across is not None and (limit is None or across > limit or across == limit and not at_left):
                return False
            a = scores[left] if len(left) > 1 else None
            b = scores[right] if len(right) > 1 else None
            if a is None and b is None:
                return True
            at_left = b is None or a is not None and a < b
            whole = left if at_left else right
            parts = known.get(whole) or self._last_merge(whole)
            if parts is None:
                return None
            if at_left:
                limit, left = a, parts[1]
            else:
                limit, right = b, parts[0]

    def _fit(self, before: int | str | None, piece: int, key: int) -> bool:
        """Whether merging leaves the piece, and what is before it: a piece, a character that is none, or nothing."""
        text, own = self.text[piece], None
        if isinstance(before, int) and (len(text) == 1 or self._last_merge(text)):
            own = self._apart(self.text[before], text)
        if own is None:
            head = [] if before is None else [before if isinstance(before, str) else self.text[before]]
            own = self.merge("".join(head) + text) == [*head, text]
        if len(self.fits) >= self.most:
            self.fits.clear()
        self.fits[key] = own
        return own

    def path(self, text: str) -> array:
        """Segmentation of a normalised text. A character costs 8 bytes of state, in short texts more."""
        n, known, fits = len(text), len(self.text), self.fits.get
        start, one = ([-1], [1]) if n <= 64 else (array("i", [-1]), array("i", [1]))  # -1: the character alone
        last, sizes = start * (n + 1), one * (n + 1)
        for end, (size, _, piece) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            at = end - size
            # pairs by number: 0 for nothing before, then pieces, then characters
            before = last[at] + 1 or (known + 1 + ord(text[at - 1]) if at else 0)
            fit = fits(before * known + piece)
            if fit is None:
                fit = self._fit(last[at] if last[at] >= 0 else text[at - 1] if at else None, piece, before * known + piece)
            if fit:
                last[end], sizes[end] = piece, size
        return self._walk(text, sizes, last)


@lru_cache(maxsize=2)
def segmenter(path: str) -> Viterbi:
    """One automaton for each Python worker and vocabulary, of the kind that the model was trained for."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        kind = sentencepiece_model_pb2.ModelProto.FromString(f.read()).trainer_spec.model_type
    kinds = {sentencepiece_model_pb2.TrainerSpec.UNIGRAM: Viterbi, sentencepiece_model_pb2.TrainerSpec.BPE: Bpe}
    if kind not in kinds:
        raise ValueError("neither a unigram nor a BPE model")
    return kinds[kind](path)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids) of every whole text, in one pass."""

    def run(batches):
        v = segmenter(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([v.encode(t) for t in part["text"].to_pylist()], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema(doc_id=LONG, ids=BINARY))


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, text) of encoded texts."""

    def run(batches):
        v = segmenter(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [v.decode(x) for x in part["ids"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["ids"], pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Encode and decode every document: pieces, digest of the ids, and length and SHA-256 of the decoded text."""
    import public_tokenizers

    vocabulary = vocabulary or public_tokenizers.path("piece_bpe_32k.model")
    back = decode(encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return back.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.char_length("text").cast("long").alias("decoded_chars"), F.sha2("text", 256).alias("decoded_sha256")
    )
