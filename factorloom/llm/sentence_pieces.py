"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For every prefix of a string the BPE encoding has exactly one last token, and
``t`` is it for the prefix ending at ``i`` when the vocabulary string ``t`` ends
at ``i`` and is compatible with the last token of the prefix before ``t``: BPE of
the two strings together gives just those two tokens.  An Aho-Corasick automaton
lists the tokens that end at each position, compatibility is tested once a pair
and remembered, and the ids are read from the table backwards.  The table is
linear in the string, whatever its length.

Characters outside the vocabulary become byte tokens and never merge.  No piece
has the space mark after another character (checked on loading), so BPE never
crosses the start of a word and words are encoded apart and cached in the worker.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factorloom.llm.common import Memo, texts_of

SPACE = "▁"


class PieceTable:
    """Vocabulary, automaton and compatibility memo of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.end_id = sp.eos_id()
        self.pieces = {i: sp.id_to_piece(i) for i in plain}
        self.ids = {s: i for i, s in self.pieces.items()}
        self.rank = {s: -sp.get_score(i) for i, s in self.pieces.items()}
        self.bytes = {}
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:5], 16)] = i
        self.byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        if any(SPACE in s.lstrip(SPACE) for s in self.pieces.values()):
            raise ValueError("a piece continues past a word start; words can't be encoded apart")
        if sp.encode(" a  b") != sp.encode("▁a▁▁b") or sp.normalize("ﬁ é") != "▁ﬁ▁é":
            raise ValueError("only models without text normalization are supported")
        self.automaton = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.known = set(s for s in self.pieces.values() if len(s) == 1)
        self.joined = {s[i : i + 2] for s in self.pieces.values() for i in range(len(s) - 1)}
        self.sizes = {i: len(s) for i, s in self.pieces.items()}
        self.text_of = {str(i): s.replace(SPACE, " ") for i, s in self.pieces.items()}
        self.text_of |= {str(i): chr(b) for b, i in self.bytes.items() if b < 128} | {str(self.end_id): ""}
        self.compatible: dict[int, bool] = {}
        self.runs = Memo(self.encode_part)  # by the run of a word
        self.words = Memo(self.encode_word)  # by the word with its marks
        self.spaced = Memo(lambda word: self.encode_word(SPACE + word))  # by the word behind one mark

    def _pair(self, a: int, b: int) -> bool:
        """Does BPE of the two pieces' strings end with the boundary between them intact?"""
        left, text = len(self.pieces[a]), self.pieces[a] + self.pieces[b]
        cuts = list(range(len(text) + 1))
        rank = self.rank
        while len(cuts) > 2:
            best, at = None, 0
            for k in range(len(cuts) - 2):
                r = rank.get(text[cuts[k] : cuts[k + 2]])
                if r is not None and (best is None or r < best):
                    best, at = r, k + 1
            if best is None:
                break
            if cuts[at] == left:
                return False
            del cuts[at]
        return cuts == [0, left, len(text)]

    def encode_run(self, run: str) -> list[int]:
        """Ids of a string whose neighbouring characters all meet in some piece, or of one vocabulary character."""
        last = [0] * (len(run) + 1)  # id of the last token of each prefix; 0 is no piece
        compatible, sizes = self.compatible, self.sizes
        for end, token in self.automaton.iter(run):
            end += 1
            if last[end]:  # there is only one
                continue
            start = end - sizes[token]
            if start:
                before = last[start]
                if not before:
                    continue
                key = before << 20 | token
                ok = compatible.get(key)
                if ok is None:
                    ok = compatible[key] = self._pair(before, token)
                if not ok:
                    continue
            elif end > 1 and not self._alone(token):
                continue
            last[end] = token
        out, at = [], len(run)
        while at:
            token = last[at]
            out.append(token)
            at -= sizes[token]
        return out[::-1]

    def _alone(self, token: int) -> bool:
        """Does BPE of the piece's own string give the piece?"""
        ok = self.compatible.get(-token)
        if ok is None:
            text = self.pieces[token]
            cuts, rank = list(range(len(text) + 1)), self.rank
            while len(cuts) > 2:
                found = [(rank[s], k) for k in range(len(cuts) - 2) if (s := text[cuts[k] : cuts[k + 2]]) in rank]
                if not found:
                    break
                del cuts[min(found)[1] + 1]
            ok = self.compatible[-token] = len(cuts) == 2
        return ok

    def encode_word(self, word: str) -> str:
        """Ids of one word (with its space marks) as decimals joined by one space."""
        joined, out, start = self.joined, [], 0
        for k in range(1, len(word) + 1):  # cut where no piece has the two characters next to each other
            if k < len(word) and word[k - 1 : k + 1] in joined:
                continue
            run, start = word[start:k], k
            out.append(self.runs[run])
        return " ".join(out)

    def encode_part(self, run: str) -> str:
        """Ids of a run of a word as decimals joined by one space: pieces, or the bytes of one unknown character."""
        if run in self.known or len(run) > 1:
            return " ".join(map(str, self.encode_run(run)))
        return " ".join(str(self.bytes[b]) for b in run.encode("utf-8"))

    def encode(self, text: str) -> str:
        """Ids of a text in decimals joined by one space, without the end id."""
        if not text:
            return ""
        out: list[str] = []
        lead = SPACE
        for line in text.split("\n"):  # no piece has a line feed
            if not lead:
                out.append(self.words["\n"])
            if SPACE in line or "  " in line or line[:1] == " " or line[-1:] == " ":
                out += map(self.words.__getitem__, _WORD.findall(lead + line.replace(" ", SPACE)))
            elif line or lead:
                first, *rest = line.split(" ")
                if lead + first:
                    out.append(self.words[lead + first])
                out += map(self.spaced.__getitem__, rest)
            lead = ""
        return " ".join(out)

    def decode(self, ids: str) -> str:
        """Text of ids in decimals: byte tokens are joined before they are read as UTF-8, control tokens are
        nothing, and the mark put before a text is taken off again."""
        try:
            text = "".join(map(self.text_of.__getitem__, ids.split()))
        except KeyError:  # bytes of longer characters
            out = bytearray()
            for i in ids.split():
                out += self.byte_of[int(i)] if int(i) in self.byte_of else self.text_of.get(i, "").encode()
            text = out.decode("utf-8", errors="replace")
        return text[1:] if text[:1] == " " else text


_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@cache
def piece_table(path: str) -> PieceTable:
    """One table a Python worker and file."""
    return PieceTable(path)


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs``.

    The ids are those of the sentencepiece library followed by the end id; the
    decoded text is its ``decode`` of them.  A null or empty text is the end id
    alone and decodes to the empty string.  Rows are treated one by one, so
    repeated rows and null ``doc_id`` values simply come back.
    """

    def run(batches):
        table = piece_table(model_path)
        end = str(table.end_id)
        for batch in batches:
            n_tokens, ids_sha, text_sha = [], [], []
            for value in batch.column("text"):
                ids = f"{table.encode(value.as_py())} {end}".lstrip()
                n_tokens.append(ids.count(" ") + 1)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(table.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``encode_decode`` of the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
