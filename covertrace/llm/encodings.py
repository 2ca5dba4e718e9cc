"""Text decoded with the wrong character encoding: candidate decodings weighed by their description length."""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covertrace.session import written

#: Encodings in which bytes may have been read by mistake, and those that they may truly be in.
READ_AS = ("cp1252", "mac_roman", "cp850", "cp437", "cp1251", "cp1250", "cp1254", "iso8859_15", "iso8859_2")
TRULY_SINGLE = ("cp1252", "mac_roman", "cp850")
#: Further encodings in which UTF-8 may have been read; the last ones take two bytes for most letters.
READ_AS_TOO = ("cp1253", "koi8_r", "cp1256", "cp1257", "cp1255", "cp866")
READ_AS_DOUBLE = ("gbk", "big5", "shift_jis")
#: Encodings of other scripts and alphabets, which may have been read as a Western one.
FOREIGN_TRUE = ("cp1251", "koi8_r", "cp866", "iso8859_5", "cp1253", "cp1250", "iso8859_2", "cp1254", "gbk", "big5", "shift_jis")
FOREIGN_READ_AS = ("cp1252", "latin_1", "mac_roman", "cp850", "cp437", "cp1251", "koi8_r")
#: Share of a text's words that are known below which it is in none of the corpus' languages.
FAMILIAR = 0.3
#: Share of the words with signs out of place that another reading must set right, and least share of frequent letters in it.
SET_RIGHT, FREQUENT = 0.9, 0.25
HEADLINE_WORDS = 12
#: Letters in a row by which another script is told.
FOREIGN_LETTERS = 3
#: Wrong decodings that may lie upon each other.
DEEPEST = 3
#: Bytes that a chain must save for each step: one of UTF-8 proves itself by its form, one between single-byte
#: encodings doesn't, unless it turns signs within words into letters (then it must not cost more).
UTF8_COST, SINGLE_COST, IN_WORD_COST = 1, 3, 0
#: Size of a language's dictionary in bytes; texts of a block that one is trained on, and of which a known word stands in one.
DICTIONARY_BYTES, DICTIONARY_TEXTS = 65_536, 800
#: Blocks whose dictionaries are trained into one, and the pieces in bytes in which they are read for that.
BLOCKS, BLOCK_PIECE = 32, 1_024
LEVEL = 19

# Characters that texts of the corpus' languages have as a matter of course.
USUAL = "áàâäåæçéèêëíîïñóôöøœßúùûüÀÁÂÄÅÆÇÉÈÊËÍÎÏÑÓÔÖØŒÚÙÛÜ«»“”‘’„–—…€£¿¡°"
LANGUAGES = ("en", "da", "de", "es", "fr")
# Letters beyond ASCII of further alphabets in Latin script.
ALPHABETS = {
    "pl": "ąćęłńóśźż", "cs": "áčďéěíňóřšťúůýž", "sk": "áäčďéíĺľňóôŕšťúýž", "hu": "áéíóöőúüű", "ro": "ăâîșțşţ", "tr": "çğıöşüâîûi̇", "pt": "áâãàçéêíóôõúü", "sv": "åäöé",
    "hr": "čćđšž", "lt": "ąčęėįšųūž", "lv": "āčēģīķļņšūž", "et": "äõöüšž", "is": "áðéíóúýþæö", "it": "àèéìîòóù", "ca": "àçèéíïòóúü·", "nl": "áéëïóöüè", "vi": "ăâđêôơưàảãáạằẳẵắặầẩẫấậèẻẽéẹềểễếệìỉĩíịòỏõóọồổỗốộờởỡớợùủũúụừửữứựỳỷỹýỵ",
}
_ALPHABETS = [frozenset(a + a.upper()) for a in ALPHABETS.values()]
# The most frequent letters of Russian, Greek, Chinese and Japanese text.
FREQUENT_LETTERS = frozenset("оеаинтсрвл" "αοιετσνηυρ" "的一是不了人我在有他这中大来上个国到说们為时要就出会可也你对生能而子那得于着下自之年過发后作里以這來個國說們時會對於裡後發在關" "のにはをたがでてとしれさるいもなかっりくんま")

_UPPER = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
#: A field with none of these is sound: characters out of the usual, a capital after a small letter, lost letters.
_RARE = _UPPER + "…°¿¡£€«»„‚"
_SMALL = "a-zß-öø-ÿ"
# one class of characters that are worth a look comes first, so that the search passes quickly over all others
SUSPECT = (
    rf"[^\x00-\x3e\x40-\x7f{''.join(c for c in USUAL if c not in _RARE)}]"
    rf"(?:(?<=[^\x00-\x7f{USUAL}])|(?<=[{_SMALL}][{_UPPER}])|(?<=[{_UPPER}][{_UPPER}])(?=[a-z])|(?<=…)(?=[{_SMALL}])"
    rf"|(?<=[{_SMALL}][°¿¡£€«»„])(?=[{_SMALL}])|(?<=[{_SMALL}]‚)|(?<=¿)(?= )|(?<=[A-Za-z]\?)(?=[a-z]))"
)
_SUSPECT = re.compile(SUSPECT)
_IN_WORD = re.compile(rf"[a-zß-öø-ÿ](?:[^\x00-\x7f\u0100-\u017f™©®…{USUAL}]|[{_UPPER}]|[°¿¡£€«»„‚])(?=[a-zß-öø-ÿ ,.;:?!])|(?<!\w)ì(?=\w)|[\u0400-\u04ff](?=\d)|(?<!\w)[A-Z][\u0400-\u04ff](?=[a-z])|(?<!\w)[A-Z][ÂÕ](?=\s)")
# addresses, and words wholly in one other script with capitals where capitals may be, are sound
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+|\S+\.\w{2,}/\S*|\S+\?[\w.-]+=\S*")
_FOREIGN_WORD = re.compile(
    "(?<![A-Za-zÀ-ɏ\u0370-\u04ff])(?:[\u0400-\u042f]?[\u0430-\u045f]{2,}|[\u0400-\u042f]{3,}|[\u0386-\u03ab]?[\u03ac-\u03ce]{2,}|[\u0386-\u03ab]{3,})(?![A-Za-zÀ-ɏ\u0370-\u04ff])"
    "|(?<![A-Za-zÀ-ɏ])(?<![\u0590-\u074f\u0900-\u0e7f\u3000-\u30ff\u3400-\u9fff\uac00-\ud7af\uff01-\uff60])[\u0590-\u074f\u0900-\u0e7f\u3000-\u30ff\u3400-\u9fff\uac00-\ud7af\uff01-\uff60]++(?![A-Za-zÀ-ɏ])"
)
_LONE_FOREIGN = re.compile("(?<!\\S)[\u0400-\u04ff\u0370-\u03ff]{1,2}(?=[\\s,.;:!?]|$)")
_LETTER_RUN = re.compile(r"[^\W\d_]+")
_ASKED = re.compile(r"([^\W\d_]+)\?([a-zß-öø-ÿ]+)")
# a word with a sign, a control character or another script's letter within, or of accented letters alone
_ODD_WORD = re.compile(
    "[^\\W\\d_]*(?:(?<=[^\\W\\d_])[\u0080-\u00bf\u02c6-\u02dd\u2020-\u2022\u2030\u20ac\u2122\u2500-\u25ff](?=[^\\W\\d_])|[a-zA-Z][\u0370-\u04ff]|[\u0370-\u04ff][a-zA-Z])\\S*"
    "|(?<![^\\W_])[À-ÿ\u0152-\u0153\u0160-\u0161\u017d-\u017e\u0178\u0192\u0080-\u00bf]{4,}(?![^\\W_])|[\u0430-\u044f][\u0410-\u042f]+"
)
_RUN = re.compile(r"[^\x00-\x7f]+")
_LOST = re.compile("[�\x80-\x9f]|(?<!\\S)Ã(?=\\s)|[A-Za-zß-öø-ÿ]\\?[a-zß-öø-ÿ]")
_PIECE = re.compile(r"[^\n.!?]*(?:[.!?](?![\s\n]|$)[^\n.!?]*)*[.!?]*[ \n]*")


def _letters(encoding: str) -> set[str]:
    return set(bytes(range(128, 256)).decode(encoding, "ignore"))


#: What a reading may consist of beyond ASCII: any letter of the encodings, and control characters.
_READABLE = set(USUAL).union(*(_letters(e) for e in READ_AS)) | {chr(c) for c in range(0x80, 0xA0)}


def _controls(error: UnicodeError) -> tuple[bytes, int]:
    """Control characters beyond ASCII as their bytes."""
    kept = error.object[error.start : error.end]
    if all(0x80 <= ord(ch) < 0xA0 for ch in kept):
        return kept.encode("latin_1"), error.end
    raise error


codecs.register_error("covertrace_controls", _controls)


def to_bytes(text: str, encoding: str) -> bytes | None:
    """The bytes that were read as ``text``; unassigned bytes stand as control characters. None where there are none."""
    try:
        return text.encode(encoding, "covertrace_controls")
    except UnicodeEncodeError:
        return None


@lru_cache(maxsize=65_536)  # runs repeat
def undo_utf8(run: str, double: bool = False) -> tuple[tuple[str, str], ...]:
    """(chain, text) of each reading of a run of letters beyond ASCII as UTF-8 that was read in another encoding (``double``: in one of two bytes too, as in Latin script)."""
    found: dict[str, str] = {}
    for encoding in (*READ_AS, *READ_AS_TOO, *(READ_AS_DOUBLE if double else ())):
        raw = to_bytes(run, encoding)
        if raw is None:
            continue
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        # letters of scripts that the corpus doesn't have prove nothing by one or two
        many = encoding not in READ_AS_DOUBLE and (not double or len(text) >= FOREIGN_LETTERS)
        if text != run and len(text) < len(run) + (encoding in READ_AS_DOUBLE) and all(ch in _READABLE or ch < "\x80" or (many and ch.isalpha()) for ch in text):
            found.setdefault(text, f"{encoding}>utf-8")
    return tuple((chain, text) for text, chain in found.items())


class Weigher:
    """Description length of a text under the dictionary of its language; sizes are held until ``forget``."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.compressors = {}
        self.held: dict[tuple[str, str], int] = {}
        for language, data in dictionaries.items():
            d = zstandard.ZstdCompressionDict(data) if data[:4] == b"\x37\xa4\x30\xec" else zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors[language] = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        if not self.compressors:
            self.compressors[""] = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

    def size(self, text: str, language: str) -> int:
        size = self.held.get((text, language))
        if size is None:
            size = self.held[text, language] = len(self.compressors[language].compress(text.encode("utf-8", "surrogatepass")))
        return size

    def forget(self) -> None:
        self.held.clear()

    def language(self, text: str) -> str:
        """The language whose dictionary describes ``text`` most shortly."""
        return min(self.compressors, key=lambda c: (self.size(text, c), c))


class Restorer:
    """Finds the damaged fields and undoes what can be undone."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.weigher = Weigher(dictionaries)
        self.known: frozenset[str] = getattr(dictionaries, "words", frozenset())

    def _familiar(self, text: str) -> bool:
        """Whether a text with letters of another alphabet is in one of the corpus' languages all the same, by its words."""
        odd = {ch for ch in text if ch > "\x7f" and ch.isalpha() and ch not in USUAL}
        if not odd or not self.known or not any(odd <= a for a in _ALPHABETS):
            return True
        return self._share_known(text) >= FAMILIAR

    def _share_known(self, text: str) -> float:
        """Share of the plain words that the sample of sound texts has; of a headline's few words one is enough."""
        words = [w.lower() for w in _LETTER_RUN.findall(text) if len(w) > 1 and w.isascii()]
        n = sum(w in self.known for w in words)
        return 1.0 if n and len(words) < HEADLINE_WORDS else n / max(1, len(words))

    def _home(self, piece: str) -> bool:
        """Whether a sentence is in Latin script and, as far as words are known, in a language of the corpus."""
        letters = [ch for ch in piece if ch.isalpha()]
        latin = 2 * sum(ch.isascii() for ch in letters) >= len(letters)
        return latin and (not self.known or self._share_known(piece) >= FAMILIAR)

    def _asked(self, m: re.Match, language: str) -> bool:
        """Whether a question mark within a word stands for a lost letter: a letter there describes it more shortly than a blank after the mark."""
        left, right = m[1].lower(), m[2]
        if left in self.known and right in self.known and min(len(left), len(right)) > 1:
            return False
        size = self.weigher.size(f" {left}? {right} ", language)
        least = min(self.weigher.size(f" {left}{ch}{right} ", language) for ch in "åæøéèêáíóúñäöüßçàô")
        return least < size or (least == size and min(len(left), len(right)) < 3)

    def _bare(self, text: str, language: str | None = None) -> str:
        """``text`` without what is sound in itself: addresses, words of other scripts, and question marks that are meant."""
        if not text.isascii():
            short = _FOREIGN_WORD.sub("", text)
            text = short if short == text else _LONE_FOREIGN.sub("", short)
        text = _ADDRESS.sub(" ", text) if "/" in text or "=" in text else text
        if language is not None and "?" in text:
            text = _ASKED.sub(lambda m: m[0] if self._asked(m, language) else f"{m[1]} {m[2]}", text)
        return text

    def _foreign(self, piece: str, chains: set[str]) -> str:
        """``piece`` read in an encoding of another script or alphabet, if that sets its odd words right."""
        odd, beyond = len(_ODD_WORD.findall(piece)), sum(not w.isascii() for w in piece.split())
        if odd < 2 or 2 * odd < beyond:
            return piece
        best, best_chain, most = piece, "", 0.0
        for wrong in FOREIGN_READ_AS:
            raw = to_bytes(piece, wrong)
            if raw is None:
                continue
            for right in FOREIGN_TRUE:
                if right == wrong:
                    continue
                try:
                    tried = raw.decode(right)
                except UnicodeDecodeError:
                    continue
                letters = [ch for ch in tried if ch > "\x7f" and ch.isalpha()]
                if not letters or len(_ODD_WORD.findall(tried)) > (1 - SET_RIGHT) * odd or any(0x80 <= ord(ch) < 0xA0 for ch in tried):
                    continue
                if all(ch < "\u0250" or 0x1E00 <= ord(ch) < 0x1F00 for ch in letters):
                    fit = 0.5 if any(set(letters) <= a for a in _ALPHABETS) else 0.0
                else:
                    fit = sum(ch.lower() in FREQUENT_LETTERS for ch in letters) / len(letters)
                    fit = fit if not self._bare(tried) or not _SUSPECT.search(self._bare(tried)) else 0.0
                if fit >= FREQUENT and fit > most:
                    best, best_chain, most = tried, f"{wrong}>{right}", fit
        if best_chain:
            chains.add(best_chain)
        return best

    def _utf8(self, piece: str, language: str, chains: set[str]) -> str:
        """``piece`` with runs read as UTF-8, as often as that shortens its description."""
        letters = sum(ch.isalpha() for ch in piece)
        double = 2 * sum(ch.isascii() and ch.isalpha() for ch in piece) >= letters
        for _ in range(DEEPEST):
            options: dict[str, tuple[tuple[str, str], ...]] = {}
            for run in set(_RUN.findall(piece)):
                if found := undo_utf8(run, double):
                    options[run] = found
            if not options:
                break
            best, best_chains = piece, set()
            size = self.weigher.size(piece, language)
            for encoding in dict.fromkeys(c for found in options.values() for c, _ in found):
                # all runs by one encoding; a run that this doesn't fit by its own
                pick = {run: next((t for c, t in found if c == encoding), found[0][1]) for run, found in options.items()}
                tried = _RUN.sub(lambda m: pick.get(m[0], m[0]), piece)
                cost = self.weigher.size(tried, language) + UTF8_COST
                if cost < size or (best is piece and len(tried) < len(piece) and cost <= size + UTF8_COST + 1):
                    best, best_chains, size = tried, {encoding}, min(size, cost - UTF8_COST)
            if best is piece:
                break
            piece = best
            chains |= best_chains
        return piece

    def _single(self, piece: str, language: str, chains: set[str]) -> str:
        """``piece`` moved from one single-byte encoding to another, wholly or its suspect words, if that saves enough."""
        odd, marks = len(_IN_WORD.findall(piece)), len(_SUSPECT.findall(piece))
        best, best_chain, least = piece, "", 0
        seen = {piece}
        for chain, tried in self._moved(piece):
            if tried in seen:  # weighed before, under another chain
                continue
            seen.add(tried)
            left = len(_SUSPECT.findall(tried))
            if left >= marks or any(ch == "\ufffd" or 0x80 <= ord(ch) < 0xA0 for ch in tried):
                continue
            cost = self.weigher.size(tried, language)
            needed = IN_WORD_COST if odd and not _IN_WORD.search(tried) else SINGLE_COST
            if cost + needed <= self.weigher.size(piece, language) and (not best_chain or cost + left < least):
                best, best_chain, least = tried, chain, cost + left
        if best_chain:
            chains.add(best_chain)
        return best

    @staticmethod
    def _moved(piece: str) -> Iterator[tuple[str, str]]:
        """(chain, text): ``piece`` as a whole in another encoding, and with only its suspect words in it."""
        words = piece.split(" ")
        suspects = [k for k, word in enumerate(words) if _SUSPECT.search(word)]
        for wrong in READ_AS:
            whole = to_bytes(piece, wrong)
            apart = [(k, raw) for k in suspects if (raw := to_bytes(words[k], wrong)) is not None]
            for right in TRULY_SINGLE:
                if right == wrong:
                    continue
                if whole is not None:
                    yield f"{wrong}>{right}", whole.decode(right, "replace")
                moved = words.copy()
                for k, raw in apart:
                    moved[k] = raw.decode(right, "replace")
                yield f"{wrong}>{right}", " ".join(moved)

    def restore(self, text: str | None) -> tuple[bool, str | None, str]:
        """(whether damaged, the text as far as it can be restored, the chains undone)."""
        if not text or not _SUSPECT.search(text) or not _SUSPECT.search(self._bare(text)):
            return False, text, ""
        self.weigher.forget()
        language = self.weigher.language(text)
        if not _SUSPECT.search(self._bare(text, language)):
            return False, text, ""
        familiar = self._familiar(text)
        chains: set[str] = set()
        out = []
        for piece in _PIECE.findall(text):
            if piece and _SUSPECT.search(self._bare(piece, language)):
                piece = self._utf8(piece, language, chains)
                if _SUSPECT.search(self._bare(piece, language)):
                    if not self._home(piece):
                        piece = self._foreign(piece, chains)
                    if familiar and _SUSPECT.search(self._bare(piece, language)):
                        piece = self._single(piece, language, chains)
            out.append(piece)
        restored = "".join(out)
        lost = bool(_LOST.search(self._bare(restored, language)))
        return bool(chains) or lost or bool(_LOST.search(self._bare(text, language))), restored, " ".join([*sorted(chains), *["lost"] * lost])


class Dictionaries(dict):
    """Dictionaries by language, with the words of the texts they were made from."""

    words: frozenset[str] = frozenset()


TRAINED = "language string, block long, dictionary binary, texts long, words array<struct<word:string,n:long>>"


def _trained(samples: list[bytes]) -> bytes:
    """A dictionary made from all ``samples``, of which the trainer would keep a quarter aside; of few (as in tests) the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, split_point=1.0).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)


def _rows(batches: Iterator[pd.DataFrame], column: str) -> Iterator[tuple[tuple[str, int], object]]:
    for pdf in batches:
        yield from zip(zip(pdf["language"], pdf["block"]), pdf[column])


def _train_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The dictionary of each block's sound texts, which come one block after another, and in how many of them each word stands."""
    for (language, block), found in groupby(_rows(batches, "body_text"), lambda row: row[0]):
        # the pattern is searched here, as the JVM takes many times as long over it
        texts = [text for _, text in found if not _SUSPECT.search(text)]
        if not texts:
            continue
        words = Counter(w for text in texts for w in set(_LETTER_RUN.findall(text.lower())))
        row = (language, block, _trained([text.encode() for text in texts]), len(texts), [{"word": w, "n": n} for w, n in words.items()])
        yield pd.DataFrame([row], columns=["language", "block", "dictionary", "texts", "words"])


def _train_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One dictionary of the dictionaries of each group of blocks."""
    for (language, block), found in groupby(_rows(batches, "dictionary"), lambda row: row[0]):
        held = [bytes(d) for _, d in found]
        if len(held) > 1:
            held = [_trained([d[k : k + BLOCK_PIECE] for d in held for k in range(0, len(d), BLOCK_PIECE)])]
        yield pd.DataFrame([(language, block, held[0])], columns=["language", "block", "dictionary"])


def train_dictionaries(articles: DataFrame) -> Dictionaries:
    """A dictionary for each language from all its sound texts, and the words that stand in one of ``DICTIONARY_TEXTS`` of them.

    The texts are taken in blocks of ``DICTIONARY_TEXTS`` by a hash of the id; each gives a dictionary, ``BLOCKS``
    dictionaries give one, until each language has its own. No task holds more than one block. Words are counted over all
    texts. Few texts (as in tests) are taken as they are, as a raw dictionary.
    """
    language = F.lower(F.trim("language"))
    counts = articles.where(language.isin(*LANGUAGES)).groupBy(language.alias("language")).count().collect()  # five languages
    blocks = F.lit(1).cast("long")
    for name, n in counts:
        blocks = F.when(F.col("language") == name, F.lit(-(-n // DICTIONARY_TEXTS))).otherwise(blocks)
    texts = articles.select(language.alias("language"), "body_text", F.xxhash64("id").alias("h"))
    bodies = texts.where(F.col("language").isin(*LANGUAGES) & (F.length("body_text") > 200))
    # the number of tasks is set, as the bytes moved are too few for it to follow from them
    tasks = 4 * articles.sparkSession.sparkContext.defaultParallelism
    in_order = lambda df, *by: df.repartition(tasks, "language", "block").sortWithinPartitions("language", "block", *by)
    trained = written(in_order(bodies.withColumn("block", F.pmod("h", blocks)), "h", "body_text").mapInPandas(_train_texts, TRAINED))
    totals = trained.groupBy("language").agg(F.sum("texts").alias("texts"))
    counted = trained.select("language", F.explode("words").alias("w")).groupBy("language", "w.word").agg(F.sum("w.n").alias("n"))
    known = counted.join(F.broadcast(totals), "language").where(F.col("n") * DICTIONARY_TEXTS >= F.col("texts"))
    out = Dictionaries()
    out.words = frozenset(r.word for r in known.select("word").distinct().toLocalIterator())
    level = trained.select("language", "block", "dictionary")
    most = max((-(-n // DICTIONARY_TEXTS) for _, n in counts), default=1)
    while most > 1:
        grouped = level.select("language", F.floor(F.col("block") / BLOCKS).alias("block"), "dictionary", F.col("block").alias("at"))
        level = written(in_order(grouped, "at").mapInPandas(_train_blocks, "language string, block long, dictionary binary"))
        most = -(-most // BLOCKS)
    out |= {r.language: bytes(r.dictionary) for r in level.collect()}
    return out


RESTORED = "article_id long, field_name string, restored string, chains string"


def damaged_fields(articles: DataFrame) -> DataFrame:
    """(article_id, field_name, restored, chains) of each headline or body with wrongly decoded parts.

    Fields with only usual characters are passed over by a pattern. Of others, each sentence is read
    by every chain of encodings that fits it; the reading of least description length (compressed size under the
    language's dictionary, plus the chain's cost) stands, and the sentence as it is if none is shorter. Lost
    letters (replacement and control characters, question marks within words) count as damage that stays. Null
    and empty fields are sound; repeated rows come out as often as they stand.
    """
    sent = articles.sparkSession.sparkContext.broadcast(train_dictionaries(articles))

    def restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(sent.value)
        for pdf in batches:
            rows = []
            for i, headline, body in zip(pdf["id"], pdf["headline"], pdf["body_text"]):
                for field, text in (("headline", headline), ("body_text", body)):
                    damaged, restored, chains = restorer.restore(text)
                    if damaged:
                        rows.append((i, field, restored, chains))
            yield pd.DataFrame(rows, columns=["article_id", "field_name", "restored", "chains"])

    return articles.select("id", "headline", "body_text").mapInPandas(restore, RESTORED)
