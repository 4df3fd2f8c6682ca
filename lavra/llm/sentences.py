"""Sentence units of documents in any language, with their places.

A text falls into blocks at blank lines, a block into items at lines that start with a list marker or a time in square
brackets. Within an item the end marks of all scripts are weighed in order:

* ``! ?`` and the full stops of CJK, Arabic, Devanagari end a sentence wherever they stand, marks and closing quotes or
  brackets after them belong to it;
* an ellipsis ends one unless a lower-case word follows, in Chinese and Japanese never by itself;
* a blank between two Thai letters separates sentences;
* a period is weighed by the word before it: abbreviations that are never final end nothing, those that may be final
  end a sentence unless a lower-case word or a sign of continuation follows, initials go with the name after them;
* a quotation or bracket opened after the sentence has begun is passed over whole.

Which words are abbreviations is not listed anywhere. The document is asked first, by its unambiguous uses of the word
elsewhere: with a period in mid-sentence (a comma or the like after it, a number that ends a clause, or a lower-case word
if the document starts its sentences with capitals) it is an abbreviation, without a period in mid-sentence it is none;
capitalised words seen in mid-sentence are proper names, before which a short capitalised word with a period is a title.
Where the document says nothing, or both, the counts of the word's contexts over the whole corpus decide.

Every place is looked at from as far as it takes: no word, blank or run of signs is too long. What was found once (the
next letter, the start of a dotted word, open brackets by kind) is kept, so the work grows with the text's length.

Places are code points, the end is exclusive, white space at both ends is left out. Null, empty and blank texts have no
sentence. Nothing is cut off: every other character lies in exactly one sentence. Repeated rows give their sentences each.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.session import staged

_NL = r"(?>\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])"
_BLANK_LINE = regex.compile(rf"{_NL}\s*?{_NL}\s*|\u2029\s*")
_LINE = regex.compile(rf"{_NL}[^\S\n\r\x0b\x0c\x85\u2028\u2029]*")
_MARKER = regex.compile(r"(?P<time>\[\d{1,2}[:.h]\d{2}(?:[:.]\d{2})?\])|(?P<bullet>[•‣◦▪●·*])\s|(?P<dash>[-–—])\s+|(?P<number>\(?\d{1,3}[.)])\s+|(?P<letter>\(?\p{Ll}\))\s+")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")


def _ranges(kinds: str) -> str:
    """A character class of all code points whose category starts with one of ``kinds``."""
    out = []
    for yes, run in groupby(range(sys.maxunicode + 1), lambda c: unicodedata.category(chr(c))[0] in kinds):
        if yes:
            codes = list(run)
            out.append(f"{re.escape(chr(codes[0]))}-{re.escape(chr(codes[-1]))}")
    return "".join(out)


_LETTERS = re.compile(rf"[{_ranges('LM')}]+")
_NAME_AHEAD = regex.compile(r"\p{Lu}[\p{L}\p{M}]+")
_NAME = regex.compile(r"(?<=\p{Ll}[ \t])(\p{Lu}[\p{L}\p{M}]+)")
_INK = re.compile(r"\S")
_ALNUM = re.compile(r"[^\W_]")
_CLAUSE_END = re.compile(r"\s*\d[\d.,]*(?=[,;:!?)]|\.(?:\s|$))(?<!\.)")
_OPEN = "“„«「『（(〔[{《〈【‹"
_CLOSE = "”»」』）)〕]}》〉】›"
_PAIR = dict(zip("”»」』）)〕]}》〉】›", "“«「『（(〔[{《〈【‹"))
_MARKS = ".!?。！？．｡؟۔।॥…⋯"
_FINAL = set("!?。！？．｡؟۔।॥")
_THAI = r"[ก-ฺเ-๎]"
_EVENT = re.compile(rf"[{re.escape(_MARKS)}]+|[\"{re.escape(_OPEN + _CLOSE)}]|(?<={_THAI})[^\S\n\r]+(?={_THAI})")
_CONTINUES = set(",;:،；，、：-–—/")

#: Abbreviations that are never final, that may be, and words that with a period announce a number.
NEVER, MAYBE, NUMBER = "A", "B", "N"
LEAST_SEEN = 20
BROADCAST_WORDS = 200_000


def items(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, start of content after a marker, end) of each block's items."""
    at = 0
    for gap in [*_BLANK_LINE.finditer(text), None]:
        end = gap.start() if gap else len(text)
        if at < end and not text[at:end].isspace():
            yield from _block_items(text, at, end)
        at = gap.end() if gap else end


def _block_items(text: str, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    starts: list[tuple[int, int]] = []
    first_kind, number = None, 0
    head = at
    while text[head].isspace():
        head += 1
    for line_end, pos in [(at, head), *((m.start(), m.end()) for m in _LINE.finditer(text, head, end))]:
        first = pos == head
        m = _MARKER.match(text, pos, end)
        kind = m.lastgroup if m else "none"
        ok = bool(m)
        if kind == "dash":
            ok = first or first_kind == "dash" or not text[m.end() : m.end() + 1].islower()
        elif kind == "number":
            n = int("".join(c for c in m.group() if c.isdigit()))
            k = line_end
            while k > at and text[k - 1].isspace():
                k -= 1
            before = text[k - 1 : k] if k > at else ""
            ok = first or first_kind == "number" or (n == number + 1 and (n > 1 or before in _MARKS + ":;"))
            number = n if ok else number
        elif kind == "letter":
            ok = first or first_kind == "letter"
        if first:
            first_kind = kind
        if ok:
            starts.append((pos, m.end()))
    if not starts or starts[0][0] > at and text[at : starts[0][0]].strip():
        starts.insert(0, (at, at))
    for (s, c), nxt in zip(starts, [*starts[1:], (end, end)]):
        yield s, c, nxt[0]


def _pairs(events: list[tuple[int, str]]) -> dict[int, int]:
    """Closing place of every quotation or bracket that is closed among an item's events."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    open_at: dict[str, list[int]] = {}  # places in the stack by kind
    for at, ch in events:
        if ch[0] in _MARKS:
            continue
        if ch == '"':
            kind = '"' if open_at.get('"') else None
        elif ch == "“" and open_at.get("„"):
            kind = "„"
        else:
            kind = _PAIR.get(ch)
        if kind is None:
            if ch == '"' or (len(ch) == 1 and ch in _OPEN):
                open_at.setdefault(ch, []).append(len(stack))
                stack.append((ch, at))
        elif open_at.get(kind):
            k = open_at[kind][-1]
            out[stack[k][1]] = at
            while len(stack) > k:  # what was opened inside and not closed is given up
                open_at[stack.pop()[0]].pop()
    return out


class _WordChars(dict):
    """Whether a character can stand in a word before a period: a letter or mark, but not of Chinese or Japanese."""

    def __missing__(self, ch: str) -> bool:
        out = self[ch] = unicodedata.category(ch)[0] in "LM" and not _CJK.match(ch)
        return out


_IN_WORD = _WordChars()


class Kinds(dict):
    """What the corpus says of words, with the length of its longest."""

    def __init__(self, known: dict[str, str]) -> None:
        super().__init__(known)
        self.longest = max(map(len, known), default=0)


def _plain_words(text: str) -> list[str]:
    """The words that stand without a period within a line: letters only, a letter or digit after the blank."""
    out = []
    for line in text.splitlines():
        tokens = line.split()
        out += [a for a, b in zip(tokens, tokens[1:]) if (a.isalpha() or (not a.isascii() and _LETTERS.fullmatch(a))) and b[0].isalnum()]
    return out


_NO_USES: Counter = Counter()


class _Document:
    """A text with its items and end marks, and what it says of its own words, worked out when first asked."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.items = [(s, c, e, [(m.start(), m.group()) for m in _EVENT.finditer(text, c, e)]) for s, c, e in items(text)]
        self.pairs = [_pairs(i[3]) for i in self.items]
        self._from = self._alnum = -1
        self._starts: dict[int, int] = {}
        self._said: dict[str, Counter] | None = None
        self._plain: set[str] | None = None
        self._names: set[str] | None = None

    def alnum_from(self, at: int) -> int:
        """The place of the first letter or digit from ``at`` on."""
        if not self._from <= at <= self._alnum:
            m = _ALNUM.search(self.text, at)
            self._from, self._alnum = at, m.start() if m else len(self.text)
        return self._alnum

    def ahead(self, at: int, end: int) -> str:
        """What follows: ``c`` a sign of continuation, ``l`` a lower-case word, ``U`` a capital or an opening mark, ``d`` a digit, ``x`` a letter without case or signs only, ``E`` nothing."""
        m = _INK.search(self.text, at, end)
        if not m:
            return "E"
        if m.group() in _CONTINUES:
            return "c"
        if m.group() in "¡¿":
            return "U"
        k = self.alnum_from(m.start())
        if k >= end:
            return "x"
        ch = self.text[k]
        if not ch.isalpha():
            return "d"
        return "l" if ch.islower() else "U" if ch.isupper() or ch.istitle() else "x"

    def word_at(self, s: int, p: int) -> int:
        """Where the word that ends at ``p`` starts, from ``s`` on, with the periods inside it."""
        text, k = self.text, p
        while k > 0:
            ch = text[k - 1]
            if ch == "." and k < p and text[k] != "." and k > 1 and _IN_WORD[text[k - 2]]:
                if k - 1 in self._starts:
                    k = self._starts[k - 1]
                    break
            elif not _IN_WORD[ch]:
                break
            k -= 1
        self._starts[p] = k
        k = max(k, s)
        while k < p and text[k] == ".":
            k += 1
        return k

    def contexts(self) -> Iterator[tuple[str, str, int]]:
        """(word, what follows, place) for every single period after a word, outside quotations."""
        text = self.text
        for (_, content, end, events), pairs in zip(self.items, self.pairs):
            quotes = iter(sorted((a, b) for a, b in pairs.items() if text[a] not in "([{（"))
            quote, until = next(quotes, None), -1
            for p, mark in events:
                while quote and quote[0] < p:
                    until, quote = max(until, quote[1]), next(quotes, None)
                if mark != "." or p < until:
                    continue
                nxt = text[p + 1 : p + 2]
                if nxt.isalnum() or nxt in (".", "…"):
                    continue
                k = self.word_at(content, p)
                before = text[k - 1 : k]
                if k < p and not (before.isdigit() or before in ("_", ".")):
                    yield text[k:p], self.ahead(p + 1, end), p

    def _cased(self) -> bool:
        """Whether the document starts its sentences with capitals: none after a blank line, list marker, ``!`` or ``?`` starts otherwise."""
        text, upper = self.text, 0
        for _, content, end, events in self.items:
            for at in (content, *(p + len(m) for p, m in events if not _FINAL.isdisjoint(m))):
                k = self.alnum_from(at)
                if k < end and text[k].isalpha() and (at == content or text[at : at + 1].isspace()):
                    if text[k].islower():
                        return False
                    upper += text[k].isupper()
        return upper > 0

    def uses(self, word: str) -> Counter:
        """The document's uses of the word with a period: ``short`` where no sentence can end (``own_`` and what follows is
        a share of them), ``digits`` before a number, ``number`` before one that ends a clause, ``final`` before a capital or
        nothing."""
        if self._said is None:
            self._said = {}
            seen = list(self.contexts())
            cased = any(what == "l" for _, what, _ in seen) and self._cased()
            for w, what, p in seen:
                said = self._said.setdefault(w, Counter())
                if what == "c" or (what == "l" and cased):
                    said.update(("short", f"own_{what}"))
                elif what == "d":
                    said.update(("digits", "number") if _CLAUSE_END.match(self.text, p + 1) else ("digits",))
                elif what in "UE":
                    said["final"] += 1
        return self._said.get(word) or _NO_USES

    def is_plain(self, word: str) -> bool:
        if self._plain is None:
            self._plain = set(_plain_words(self.text))
        return word in self._plain

    def is_name(self, word: str) -> bool:
        if self._names is None:
            self._names = set(_NAME.findall(self.text))
        return word in self._names

    def kind(self, word: str, ahead: str, known: dict[str, str]) -> tuple[str | None, bool]:
        """The word's kind, and whether the document decided it; the use that is being decided (``ahead``) is no evidence."""
        uses, corpus = self.uses(word), known.get(word)
        short = uses["short"] - (uses["own_" + ahead] > 0) > 0
        number = uses["number"] > 0 and uses["digits"] > 1 and not uses["final"]
        if ahead == "d" and (number or corpus == NUMBER):  # many such words are ordinary ones elsewhere
            return (NUMBER, number) if number or uses["number"] or not uses["final"] else (None, True)
        if not short and corpus is None:
            return None, False
        ordinary = uses["final"] > 0 or self.is_plain(word)
        if short and not ordinary:
            return (corpus if corpus in (NEVER, MAYBE) else MAYBE), True
        if not short and self.is_plain(word):
            return None, True
        return corpus, False


class _Silent(_Document):
    """A document that says nothing of its words: the corpus alone decides. For measuring what documents add."""

    def kind(self, word: str, ahead: str, known: dict[str, str]) -> tuple[str | None, bool]:
        return known.get(word), False

    def is_name(self, word: str) -> bool:
        return False


def _chained(text: str, s: int, p: int) -> bool:
    """Whether the single letter before ``p`` follows another one with a period, from ``s`` on (``т. е``, ``J.M``)."""
    k = p - 2
    if k > s and text[k].isspace():
        k -= 1
    return k > s and text[k] == "." and unicodedata.category(text[k - 1])[0] in "LM" and (k < 2 or unicodedata.category(text[k - 2])[0] not in "LMN")


def _period_ends(doc: _Document, s: int, p: int, end: int, known: Kinds) -> bool:
    """Whether the single period at ``p`` ends a sentence."""
    text = doc.text
    nxt = text[p + 1 : p + 2]
    joined = nxt and not nxt.isspace() and nxt not in _OPEN and nxt not in _CLOSE and nxt != '"'
    if joined and (not nxt.isupper() or text[p + 2 : p + 3] == "."):
        return False
    at = doc.word_at(s, p)
    dotted = text.find(".", at, p) >= 0
    if joined:
        # A missing blank: a word in lower case, a number or an abbreviation that may be final, then a capital.
        if dotted:  # a word longer than all that are known is none of them
            return p - at <= known.longest and known.get(text[at:p]) == MAYBE
        word, before = text[at:p], text[p - 1 : p]
        if len(word) == 1:
            return known.get(word) == MAYBE
        kind = doc.kind(word, "", known)[0] if word else None
        return kind == MAYBE or (kind is None and (before.islower() or before.isdigit() or before in ")”»\""))
    k = p + 1
    while k < end and (text[k] in _CLOSE or text[k] == '"'):
        k += 1
    ahead = doc.ahead(k, end)
    if ahead == "E":
        return True
    if at == p:
        return ahead != "c"
    word = text[at:p]
    single = len(word) == 1
    chain = single and text[p - 2 : p - 1] in (".", " ", "\n") and _chained(text, s, p)
    if single and word.isupper():
        m = _INK.search(text, p + 1)
        if m and m.group().isupper() and text[m.end() : m.end() + 1] == ".":
            return False
        if chain and ahead in "Ulc":
            return False
        back = 2 if text[p - 3 : p - 1] in (". ", ".\n") else 3 if text[p - 3 : p - 2] == "." else 0
        if back and known.get(text[doc.word_at(s, p - back) : p - back]) == NEVER:
            return False
    by_document = False
    if single:
        kind = known.get(word)
    else:
        kind, by_document = doc.kind(word, ahead if k == p + 1 else "", known)
    if kind == NUMBER:
        if ahead == "d":
            return False
        kind = None
    if dotted or (chain and word.islower()):
        kind = kind or MAYBE
    elif not single and kind is None and not by_document and ahead == "U" and len(word) <= 4 and word[0].isupper() and not any(c.isupper() for c in word[1:]):
        m = _NAME_AHEAD.match(text, p + 2)
        if m and doc.is_name(m.group()) and not doc.is_plain(word) and not doc.is_plain(m.group().lower()):
            kind = NEVER
    if kind == NEVER:
        return False
    if kind == MAYBE:
        return ahead in "Udx"
    return ahead != "c"


def sentences(text: str | None, known: dict[str, str], document: type[_Document] = _Document) -> list[tuple[int, int]]:
    """The places of a text's sentences; ``known`` maps words to NEVER, MAYBE or NUMBER."""
    if not text or text.isspace():
        return []
    if not isinstance(known, Kinds):
        known = Kinds(known)
    out: list[tuple[int, int]] = []
    doc = document(text)
    for (s, content, e, events), pairs in zip(doc.items, doc.pairs):
        closers = set(pairs.values())
        start, begun, skip = s, content, content
        for p, mark in events:
            if p < skip:
                continue
            if mark.isspace():
                out.append((start, p))
                start = begun = skip = p + len(mark)
                continue
            if mark[0] not in _MARKS:
                if p in pairs and doc.alnum_from(begun) < p:
                    skip = pairs[p] + 1  # opened within the sentence: it stays whole
                continue
            r = p + len(mark)
            if not _FINAL.isdisjoint(mark):
                nxt = text[r : r + 1]
                ends = not ((nxt.isdigit() or nxt == "=" or (nxt.isascii() and nxt.islower())) and not text[p - 1 : p].isspace())
            elif mark == ".":
                ends = _period_ends(doc, begun, p, e, known)
            else:
                near = _INK.search(text, r, e)
                cjk = _CJK.match(text[p - 1 : p]) if p > begun else None
                ends = not cjk and doc.ahead(r, e) not in "lc" and not (near and _CJK.match(near.group()))
            if not ends:
                continue
            last_quote = -1
            while r < e and (text[r] in _CLOSE or (text[r] == '"' and r in closers) or text[r] in _MARKS):
                last_quote = r if text[r] in "”»」』›\"" else last_quote
                r += 1
            if last_quote >= 0 and text[r : r + 1].isspace() and doc.ahead(r, e) in "lc":
                skip = last_quote  # the marks before it would come to the same
                continue
            out.append((start, r))
            start = begun = skip = r
        if start < e:
            out.append((start, e))
    trimmed = []
    for s, e in out:
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if s < e:
            trimmed.append((s, e))
    return trimmed


def evidence(text: str, counts: Counter) -> None:
    """Add the contexts of the text's words before single periods, outside quotations, and of words without one."""
    if "." in text:
        counts.update((w, what) for w, what, _ in _Document(text).contexts())
    counts.update((w, "n") for w in _plain_words(text))


def period_words(text: str, longest: int) -> set[str]:
    """Every word of at most ``longest`` characters that can be asked for when the text's periods are decided: those before
    its periods and, of dotted ones, their ends."""
    doc, out = _Document(text), set()
    for _, content, _, events in doc.items:
        for p, mark in events:
            if mark[0] == ".":
                at = k = doc.word_at(content, p)
                if at < p - longest:
                    at = k = p - longest
                while k < p:
                    if k == at or text[k - 1] == ".":
                        out.add(text[k:p])
                    k += 1
    return out


def word_kinds(df: DataFrame, text_col: str) -> DataFrame:
    """(word, kind) of the corpus's abbreviations, from the counts of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "what", "n"])
            counts.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                evidence(t, counts)
            if len(counts) > 100_000:
                yield flush()
        yield flush()

    seen = df.select(text_col).where(F.col(text_col).isNotNull()).mapInArrow(count, "word string, what string, n long")
    sums = [F.coalesce(F.sum(F.when(F.col("what") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("l", "c", "d", "up", "x", "E", "n_plain")]
    by = seen.replace({"U": "up", "n": "n_plain"}, subset=["what"]).groupBy("word").agg(*sums)
    n = F.col("l") + F.col("c") + F.col("d") + F.col("up") + F.col("x") + F.col("E")
    by = by.withColumn("n", n).where("n > 0")
    number = (F.col("n") >= LEAST_SEEN) & (F.col("d") >= 0.8 * F.col("n"))
    inner = F.col("l") + F.col("c")
    never = (F.col("n") >= LEAST_SEEN) & (F.col("E") <= 0.005 * F.col("n")) & (F.col("n_plain") <= 0.02 * F.col("n"))
    maybe = (F.col("n_plain") <= 0.3 * F.col("n")) & (inner >= 0.25 * F.col("n")) & ((F.col("n") >= LEAST_SEEN) | ((inner >= 0.5 * F.col("n")) & (F.col("n_plain") == 0) & (F.length("word") <= 4)))
    return by.select("word", F.when(never, NEVER).when(maybe, MAYBE).when(number, NUMBER).alias("kind")).where("kind IS NOT NULL")


def sentence_units(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, s_start, s_end): one row per sentence of every document.

    The abbreviations of the corpus go to every task if they are at most BROADCAST_WORDS (counted first). Beyond that
    each document is joined with those of its own words, as the cutting itself would ask for them; the result is the same.
    """
    kinds = staged(word_kinds(df, text_col), "word-kinds")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, s_start int, s_end int"

    def cut(batch: pa.RecordBatch, known_of) -> pa.RecordBatch:
        ids, starts, ends = [], [], []
        for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            for a, b in sentences(text, known_of(i)):
                ids.append(doc)
                starts.append(a)
                ends.append(b)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["id", "s_start", "s_end"])

    few = kinds.limit(BROADCAST_WORDS + 1).collect()
    if len(few) <= BROADCAST_WORDS:
        known = df.sparkSession.sparkContext.broadcast({r["word"]: r["kind"] for r in few})

        def with_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            every = Kinds(known.value)
            for b in batches:
                yield cut(b, lambda i: every)

        return rows.mapInArrow(with_all, schema)
    longest = kinds.agg(F.max(F.length("word"))).first()[0]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, words = [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                mine = period_words(text, longest)
                keys += [key] * len(mine)
                words += mine
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.string())], ["key", "word"])

    keyed = staged(rows.withColumn("key", F.monotonically_increasing_id()), "sentence-rows")
    words = keyed.select("key", "text").where("text IS NOT NULL").mapInArrow(asked, "key long, word string")
    own = words.join(kinds, "word").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("word", "kind"))).alias("known"))

    def with_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = b.column(2).to_pylist()
            yield cut(b, lambda i: dict(maps[i] or ()))  # noqa: B023

    return keyed.join(own, "key", "left").select("id", "text", "known").mapInArrow(with_own, schema)
