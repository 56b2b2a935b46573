"""Repairs of extracted text, one document a row: foot notes, front matter, spacing, broken characters, emphasis, formulas.

Each repair is a function of whole texts, run in Arrow batches; the relation
of documents stays as it is and never shuffles.
"""

from __future__ import annotations

import re
import statistics
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.lines import in_order

EMAIL = re.compile(r"[^\s@]+@[^\s@]+\.[^\s@]+")
HEADING = re.compile(r"#{1,6}\s+(.*)$", re.S)
#: Words before a number that is no foot note.
LABELS = frozenset(
    "vol fig figure figs table tab eq eqn equation sec section ch chapter no nos p pp part appendix app step level phase study round wave day week item rq q "
    "algorithm alg def thm theorem lemma corollary version v article art line row col column page pages footnote note n eg ie cf vs finding findings "
    "observation observations insight insights hypothesis requirement goal principle stage iteration".split()
)
MOST_FRONT = 40


def blocks_of(text: str) -> list[str]:
    """Paragraphs of a text, code fences whole."""
    out, cur, fence = [], [], False
    for line in text.split("\n"):
        mark = bool(re.match(r"\s*(```|~~~)", line))
        if not line.strip() and not fence:
            out += ["\n".join(cur)] if cur else []
            cur = []
            continue
        fence ^= mark
        cur.append(line)
    return out + (["\n".join(cur)] if cur else [])


def joined(blocks: list[str], like: str) -> str:
    return "\n\n".join(blocks) + ("\n" if like.endswith("\n") else "")


# --- foot notes
def _sup(number: int) -> str:
    return f'<sup class="md-fn"><a href="#fn-{number}">{number}</a></sup>'


def leaked_notes(body: str, known: set[int]) -> tuple[str, list[tuple[int, str]]]:
    """The body without paragraphs that are notes (`3 https://...`, as text or link), and these notes.

    Paragraphs that only repeat a link's address belong to the one before.
    """
    left, found, last = [], [], None
    for p in body.split("\n\n"):
        m = re.match(r"\[?(\d{1,2})\s+(https?://\S[^\]]*)\]?(?:\((https?://\S+)\))?\s*$", p.strip())
        link = re.match(r"\[[^\]]*\]\((https?://\S+)\)\s*$", p.strip())
        if m and int(m.group(1)) not in known:
            last = m.group(3)
            known.add(int(m.group(1)))
            found.append((int(m.group(1)), last or m.group(2).strip()))
        elif not (last and link and link.group(1) == last):
            left.append(p)
            last = None
    return "\n\n".join(left), found


def linked_notes(body: str, known: set[int], evidence: list[tuple[int, str]] | None = None) -> str:
    """The first place of each note's number as a raised link.

    With evidence, pairs of a number and the words before it, only such places
    count.  Without it a number counts after a word that is no label, outside
    headings, brackets and larger numbers.
    """
    if evidence:
        for number, before in evidence:
            tail = before.split()[-1:]
            at = re.search(re.escape(tail[0]) + rf"( +){number}(?=[ \n)(.,;:]|$)", body) if tail and number in known else None
            if at:
                known = known - {number}
                body = body[: at.start(1)] + " " + _sup(number) + body[at.end() :]
        return body
    used: set[int] = set()

    def link(m: re.Match) -> str:
        number, start = int(m.group(2)), body.rfind("\n", 0, m.start()) + 1
        label = re.search(r"([A-Za-z]+)\.?$", body[start : m.start() + 1])
        no = (
            number not in known or number in used or m.group(1).isdigit() or m.group(1) in ",[/-–—" or re.match(r"[.,]\d", body[m.end() :])
            or re.match(r"#{1,6}\s", body[start:]) or label and label.group(1).lower() in LABELS
        )
        if no:
            return m.group(0)
        used.add(number)
        return f"{m.group(1)} {_sup(number)}"

    return re.sub(r"(\S) (\d{1,2})(?=[ \n)(.,;]|$)", link, body)


def footnoted(text: str, notes: list[str], evidence: list[tuple[int, str]] | None = None) -> str:
    """A text with its foot notes linked, and listed at its end; notes without a number are listed only."""
    parsed = [(int(m.group(1)), m.group(2).strip()) if (m := re.match(r"(?s)\s*(\d{1,3})[.\s]+(.*)$", n)) else (None, n.strip()) for n in notes]
    cut = re.search(r"(?im)^#{1,6}\s+(references|bibliography|참고문헌)\b", text)
    body, rest = (text[: cut.start()], text[cut.start() :]) if cut else (text, "")
    known = {i for i, _ in parsed if i is not None}
    body, leaked = leaked_notes(body, known)
    items = sorted(parsed + leaked, key=lambda x: (x[0] is None, x[0] or 0)) if leaked else parsed
    shown = [content if i is None else f'<a id="fn-{i}"></a>**{i}.** {content}' for i, content in items]
    whole = linked_notes(body, known, evidence) + ("\n" if rest and not body.endswith("\n") else "") + rest
    return whole.rstrip() + "\n\n## Footnotes\n\n" + "\n\n".join(shown) + "\n"


# --- front matter
#: Words of an address.
ADDRESS = re.compile(
    r"(?i)\b(univers\w+|institut\w*|college|department|school|tech|laborator\w+|lab|center|centre|inc\.?|llc|corp\w*|company|usa|united states|republic of)\b"
)
PERSON = re.compile(r"^[A-ZÀ-Þ][\w'’.\-]*(?: (?:[a-z]{2,3} )?[A-ZÀ-Þ][\w'’.\-]*){1,4}$")
BOILERPLATE = re.compile(r"(?i)^(permission to make|copyright|©|\(c\) \d|publication rights|this work is licensed|acm isbn|isbn|https?://doi\.org/)")
NAMED = re.compile(r"(?i)^(abstract|keywords|ccs concepts|introduction|acm reference format|categories|general terms|index terms)\b")


def is_person(text: str) -> bool:
    name = re.sub(r"[\s*∗†‡§¶\d,]+$", "", re.sub(r"^\[(.*)\]\([^)]*\)$", r"\1", text.strip()))
    return bool(PERSON.match(name)) and not NAMED.match(name)


def is_contact(block: str) -> bool:
    s = block.strip()
    return bool(EMAIL.search(s)) or (len(s) <= 160 and "," in s and bool(ADDRESS.search(s) or re.search(r"\b\d{4,6}\b", s)))


def without_contacts(text: str) -> str:
    """A text without `Corresponding author` blocks and the one to three lines of contact that follow, up to an address."""
    out, todo = [], 0
    for b in blocks_of(text):
        if re.match(r"(?i)[#>*_\s]*corresponding\s+author", b):
            todo = 3
            continue
        if todo and is_contact(b):
            todo = 0 if EMAIL.search(b) else todo - 1
            continue
        todo = 0
        out.append(b)
    return joined(out, text)


def split_authors(text: str) -> str:
    """The line of authors below the title, one paragraph an address, if it holds two addresses or more."""
    rows, seen = text.split("\n"), False
    for i, line in enumerate(rows):
        if line.startswith("#"):
            if seen:
                break
            seen = True
        elif seen and len(EMAIL.findall(line)) >= 2:
            ends = [0, *[m.end() for m in EMAIL.finditer(line)], len(line)]
            rows[i] = "\n\n".join(p for p in (line[a:b].strip() for a, b in zip(ends, ends[1:], strict=False)) if p)
            break
    return "\n".join(rows)


def placed_notes(text: str, notes: list[str]) -> str:
    """Notes of authors before the first section of the body, each behind an anchor."""
    if not notes:
        return text
    parts = blocks_of(text)
    at = next((i for i, b in enumerate(parts) if re.match(r"(?i)#{1,6}\s+[·*\s]*(\d|introduction\b)", b.strip())), min(1, len(parts)))
    block = "\n\n".join(f'<a id="fn-author-{i}"></a>{n.strip()}' for i, n in enumerate(notes, 1))
    return joined([*parts[:at], block, *parts[at:]], text)


def ordered_front(text: str) -> str:
    """Front matter in order: title, authors with what belongs to them, their notes, then the rest, without boilerplate.

    Only what stands before the first section of the body moves, and only if
    authors are headings or their addresses lie about in two lines or more.
    """
    parts = blocks_of(text)
    body = next((i for i, b in enumerate(parts[1 : MOST_FRONT + 1], 1) if re.match(r"(?i)#{1,6}\s+[·*\s]*(\d|introduction\b)", b)), None)
    if not parts or body is None or not HEADING.match(parts[0]):
        return text
    kinds = []
    for b in parts[1:body]:
        h = HEADING.match(b)
        note = re.match(r"(?i)[∗＊†‡§¶‖]\s*\S|\*(?![*\s])\S|corresponding author|equal contribution|<a id=\"fn-author", b)
        kinds.append(
            "person" if h and is_person(h.group(1)) else "heading" if h else "junk" if BOILERPLATE.match(re.sub(r"^[∗＊*†‡§¶‖]\s*", "", b)) else "note" if note
            else "affiliation" if is_contact(b) else "text"
        )
    band = next((i for i, k in enumerate(kinds) if k == "heading"), len(kinds))
    if "person" not in kinds and kinds.count("affiliation") < 2:
        return text
    authors, notes, rest, junk = [], [], [], False
    for i, (b, k) in enumerate(zip(parts[1:body], kinds, strict=True)):
        if k == "heading":
            junk = bool(re.match(r"(?i)acm reference format|permission", HEADING.match(b).group(1)))
        if k == "person":
            name = re.sub(r"[\s,]*[*∗†‡§¶\d]+$", "", HEADING.match(b).group(1).strip())
            authors.append(f"**{name}**")
        elif k == "affiliation" and authors and kinds[i - 1] == "person":
            authors[-1] += f" · {b.strip()}"
        elif k == "affiliation" or k == "text" and i < band:
            authors.append(b.strip())
        elif k == "note":
            notes.append(b.strip())
        elif k != "junk" and not junk:
            rest.append(b)
    return joined([parts[0], *authors, *notes, *rest, *parts[body:]], text)


NUMBERED = re.compile(r"(?i)#{1,6}\s+(\d|[ivx]+[.)]\s|introduction\b)")
META = re.compile(r"(?i)[#*_\s]*(keywords|index terms|ccs concepts|categories|general terms|acm reference format|additional key words)\b")
MARKER = re.compile(r"(?i)[#*_\s]*(abstract|초록)\b[\s*_:.\-–—]*")
LEAST, LEAST_MARKED, WIDEST = 150, 40, 6000


def _words_only(block: str) -> str:
    """A block without markup, on one line."""
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)|<[^>]+>", r"\1", block)
    return " ".join(re.sub(r"[*_`]+|^#{1,6}\s+", "", text).split())


def abstract_of(text: str) -> str:
    """A document's abstract as plain text, empty if none is found.

    What follows its mark counts first, over paragraphs that a page's end has
    split; else the longest paragraph before the first numbered section that
    is neither a contact, a notice nor below a heading of keywords.  A notice
    at its end is cut off.
    """
    parts = blocks_of(text)
    parts = parts[1:] if parts and HEADING.match(parts[0]) and not MARKER.match(parts[0]) else parts
    stop = next((i for i, b in enumerate(parts) if NUMBERED.match(b)), None)
    region = parts[:stop] if stop is not None else []
    for b in parts if stop is None else []:
        if sum(map(len, region)) < WIDEST:
            region.append(b)
    noise = lambda b: is_contact(b) or bool(BOILERPLATE.match(b)) or b.lstrip().startswith(("!", "|", "```", "<", "-", "- "))
    open_ = lambda t: bool(t) and t[-1] not in ".!?:…\"”)"
    end = lambda t: re.split(r"(?i)\s+(?=permission to make|copyright ©|© ?\d{4}|\(c\) \d{4})", t)[0].strip()
    marked = ""
    for i, b in enumerate(region):
        m = MARKER.match(b)
        if not m:
            continue
        marked = _words_only(b[m.end() :])
        for c in region[i + 1 :]:
            if HEADING.match(c) or META.match(c) or marked and not open_(marked):
                break
            marked = marked if noise(c) else f"{marked} {_words_only(c)}".strip()
        break
    if len(marked) >= LEAST:
        return end(marked)
    best, run, skip = "", "", False
    for b in region:
        if HEADING.match(b) or META.match(b) and len(b) < 60:
            run, skip = "", bool(META.match(b))
        elif skip or noise(b):
            skip = False
        else:
            plain = _words_only(b)
            run = f"{run} {plain}" if len(run) >= 200 and open_(run) and plain[:1].islower() else plain
            best = max(best, run, key=len)
    return end(best) if len(best) >= LEAST else end(marked) if len(marked) >= LEAST_MARKED else ""


# --- spacing
class Spaced:
    """A reference text without its blanks, with where they were."""

    def __init__(self, text: str):
        self.flat = "".join(text.split())
        self.gap, at = set(), 0
        for word in text.split():
            self.gap.add(at)
            at += len(word)

    def spaced(self, piece: str, start: int) -> str:
        return "".join((" " if k and start + k in self.gap else "") + c for k, c in enumerate(piece))

    def find(self, piece: str) -> str | None:
        """The piece with its blanks, if it occurs and its first and last occurrence agree on them."""
        first, last = self.flat.find(piece), self.flat.rfind(piece)
        if first < 0:
            return None
        got = self.spaced(piece, first)
        return got if first == last or self.spaced(piece, last) == got else None

    def respace(self, token: str, least: int = 6) -> str | None:
        """A run-together token with its blanks again: the longest pieces that the reference knows, one after another; null without one."""
        out, rest, known, before = [], token, 0, False
        while rest:
            size = next((k for k in range(len(rest), least - 1, -1) if self.find(rest[:k]) is not None), 0)
            if size:
                glue = " " if before and out[-1][-1:].isalnum() and rest[0].isalnum() else ""
                out.append(glue + self.find(rest[:size]))
                known += size
            else:
                size = 1
                out.append(rest[0])
            before, rest = size > 1, rest[size:]
        whole = "".join(out)
        return whole if known >= least and whole != token else None

    def rejoin(self, words: list[str]) -> str | None:
        """Words that are one word in the reference wherever they occur; null if they are not."""
        key = "".join(words)
        found = {self.spaced(key, m.start()) for m in re.finditer(re.escape(key), self.flat) if m.start() in self.gap and (m.end() in self.gap or m.end() == len(self.flat))}
        return key if len(key) >= 4 and found == {key} else None


def respaced(text: str, reference: str) -> str:
    """A text with the blanks of its reference: run-together words part, single capitals join the word that follow."""
    ref, fence, out = Spaced(reference), False, []
    for line in text.split("\n"):
        fence ^= line.startswith("```")
        if fence or re.match(r"\s*(!\[|<|\$\$|```|\|?\s*:?-{3,})", line):
            out.append(line)
            continue
        parts = re.split(r"(\s+)", line)
        for i, t in enumerate(parts):
            m = re.match(r"^(\W*?)([A-Za-z0-9].*?[A-Za-z0-9.,;:!?)\]])(\W*)$", t) if t.strip() and not re.search(r"://|\]\(|^[$<`]", t) else None
            new = ref.respace(m.group(2)) if m and re.search(r"[a-z].*[A-Z.,;:)]|[a-z]{12}", m.group(2)) else None
            parts[i] = m.group(1) + new + m.group(3) if new else t
        line = "".join(parts)  # noqa: PLW2901
        out.append(re.sub(r"(?<![\w-])[A-Z](?: [A-Za-z]+){1,3}(?![\w-])", lambda m: _rejoined(ref, m.group(0)), line))
    return "\n".join(out)


def _rejoined(ref: Spaced, text: str) -> str:
    words = text.split(" ")
    for n in range(len(words), 1, -1):
        if one := ref.rejoin(words[:n]):
            return " ".join([one, *words[n:]])
    return text


# --- broken characters
def _plain(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"-\s*\n\s*", "", re.sub(r"[*_`]", "", text)))


def _agreement(a: str, b: str) -> int:
    """How many characters two texts have in common at their start."""
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def unbroken(text: str, reference: str, anchor: int = 18, least: int = 8, wide: int = 80, most: int = 6) -> str:
    """Replacement characters (U+FFFD) as the reference has them, found by what stands before and behind.

    The reference is searched as it is, then without markup and with single
    blanks.  Of several places that fit, as in text that repeats, the one
    counts that agrees with the most of `wide` characters on either side, then
    the one with the fewest characters lost, then the nearest.
    """
    ref = _plain(reference)

    def fix(m: re.Match) -> str:
        for whole, form in ((reference, str), (ref, _plain)):
            left, right = form(text[max(0, m.start() - wide) : m.start()]), form(text[m.end() : m.end() + wide])
            before, behind = left[-anchor:], right[:anchor]
            if min(len(before), len(behind)) < least:
                continue
            fits, at = [], whole.find(before)
            while at >= 0:
                start = at + len(before)
                ends = range(start + 1, start + max(most, len(m.group(0))) + 1)
                fits += [(start, end) for end in ends if whole.startswith(behind, end) and "\n" not in whole[start:end]]
                at = whole.find(before, at + 1)
            if len(fits) > 1:
                agreed = lambda p: _agreement(left[::-1], whole[max(0, p[0] - wide) : p[0]][::-1]) + _agreement(right, whole[p[1] : p[1] + wide])  # noqa: B023, E731
                fits = [min(fits, key=lambda p: (-agreed(p), p[1] - p[0], abs(p[0] - m.start())))]
            if fits:
                return whole[slice(*fits[0])]
        return m.group(0)

    return re.sub("\ufffd+", fix, text)


def unpaired(text: str, reference: str, share: float = 0.3, least: int = 3) -> str:
    """Lines in which two ASCII bytes became one wide character, as the reference has them, if one place only fits."""
    flat = re.sub(r"\s+", " ", reference)
    pair = lambda c: 0x20 <= ord(c) >> 8 < 0x7F and 0x20 <= ord(c) & 0xFF < 0x7F
    out = []
    for line in text.split("\n"):
        bad = [i for i, c in enumerate(line) if pair(c)]
        shown = sum(not c.isspace() for c in line)
        if len(bad) >= least and len(bad) >= share * shown:
            low, high = bad[0], bad[-1] + 1
            lossy = "".join(chr(ord(c) >> 8) + chr(ord(c) & 0xFF) if pair(c) else c for c in line[low:high])
            words = re.findall(r"[A-Za-z]{3,}", lossy)
            found = {m.group(0) for m in re.finditer(r"\b" + r".{0,40}?".join(map(re.escape, words[:12])) + r"\w*", flat)} if words else set()
            fit = [f for f in found if len(lossy) / 2 <= len(f) <= 4 * len(lossy)]
            if len(found) == len(fit) == 1:
                line = line[:low] + fit[0] + line[high:]  # noqa: PLW2901
        out.append(line)
    return "\n".join(out)


def parse_cmap(text: str) -> dict[int, str]:
    """Codes and their characters of a character map's `bfchar` and `bfrange` parts."""
    chars = lambda h: bytes.fromhex(h).decode("utf-16-be", "replace")
    out = {}
    for part in re.findall(r"(?s)beginbfchar(.*?)endbfchar", text):
        out |= {int(a, 16): chars(b) for a, b in re.findall(r"<([0-9A-Fa-f]+)>\s*<((?:[0-9A-Fa-f]{4})+)>", part)}
    for part in re.findall(r"(?s)beginbfrange(.*?)endbfrange", text):
        for a, b, c in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<((?:[0-9A-Fa-f]{4})+)>", part):
            out |= {k: chars(c)[:-1] + chr(ord(chars(c)[-1]) + k - int(a, 16)) for k in range(int(a, 16), int(b, 16) + 1)}
    return out


def glyph_text(name: str) -> str | None:
    """The characters that a glyph's name stands for: `uni0041`, `u1F600`, `f_i`, single letters; null if it says nothing."""
    base = name.split(".")[0]
    if "_" in base:
        parts = [glyph_text(p) for p in base.split("_")]
        return "".join(parts) if all(parts) else None
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", base):
        return bytes.fromhex(m.group(1)).decode("utf-16-be", "replace")
    if m := re.fullmatch(r"u([0-9A-F]{4,6})", base):
        return chr(int(m.group(1), 16)) if int(m.group(1), 16) < 0x110000 else None
    return base if len(base) == 1 else {"space": " ", "hyphen": "-", "period": ".", "comma": ",", "fi": "fi", "fl": "fl", "ff": "ff"}.get(base)


def fixed_font(cmap: dict[int, str], names: dict[int, str]) -> dict[int, str]:
    """A font's character map, with what glyph names say where it has nothing or a replacement character."""
    wrong = {c for c in names if cmap.get(c, "\ufffd") in ("", "\ufffd", "\x00")}
    return cmap | {c: t for c in wrong if (t := glyph_text(names[c])) is not None}


# --- emphasis
def line_place(flat: str, stream: str, anchor: int = 24) -> tuple[int, int] | None:
    """About where a line's letters lie in a stream of letters, if most of five anchors that are unique agree."""
    n, k = len(flat), min(anchor, len(flat))
    hits = [stream.find(flat[o : o + k]) - o for o in sorted({(n - k) * q // 4 for q in range(5)}) if stream.count(flat[o : o + k]) == 1]
    if not hits:
        return None
    near = [h for h in hits if abs(h - statistics.median(hits)) <= max(40, n // 2)]
    return (max(0, min(near) - 30), min(len(stream), max(near) + n + max(60, n // 4))) if 2 * len(near) > len(hits) else None


def line_styles(flat: str, stream: str, styles: list[int], least: float = 0.85) -> list[int | None] | None:
    """The style of each letter of a line from a styled stream; None where too few letters match."""
    at = line_place(flat, stream) if len(flat) >= 8 else None
    if at is None:
        return None
    out: list[int | None] = [None] * len(flat)
    for a, b, n in SequenceMatcher(None, flat, stream[at[0] : at[1]], autojunk=False).get_matching_blocks():
        if n >= 3:
            out[a : a + n] = styles[at[0] + b : at[0] + b + n]
    return out if sum(s is not None for s in out) >= least * len(flat) else None


def emphasized(text: str, stream: str, styles: list[int]) -> str:
    """Body lines with marks about words that are mostly bold (1), italic (2) or both (3) in the stream; neighbours share marks."""
    out, body, fence = [], False, False
    for line in text.split("\n"):
        fence ^= bool(re.match(r"\s*(```|~~~)", line))
        if line.startswith("#"):
            body = body or bool(re.match(r"(?i)#{1,6}\s+(\d|introduction\b|abstract\b)", line))
        skip = fence or not body or line.startswith(("#", "|", "!", "<", "$$", "```")) or "*" in line or not line.strip()
        letters = [i for i, c in enumerate(line) if not c.isspace()]
        got = None if skip else line_styles("".join(line[i] for i in letters), stream, styles)
        if not got or not any(got):
            out.append(line)
            continue
        at = dict(zip(letters, got, strict=True))
        runs: list[list[int]] = []
        for k, m in enumerate(re.finditer(r"\S+", line)):
            known = [at[i] for i in range(*m.span()) if line[i].isalnum() and at[i] is not None]
            style = sum(bit for bit in (1, 2) if 2 * sum(bool(s & bit) for s in known) > len(known)) if known else 0
            if style and runs and runs[-1][2:] == [style, k - 1]:
                runs[-1][1], runs[-1][3] = m.end(), k
            elif style:
                runs.append([m.start(), m.end(), style, k])
        for a, b, style, _ in reversed(runs):
            while b > a and not line[b - 1].isalnum() and at.get(b - 1) != style:
                b -= 1  # noqa: PLW2901
            mark = {1: "**", 2: "*", 3: "***"}[style]
            line = line[:a] + mark + line[a:b] + mark + line[b:]  # noqa: PLW2901
        out.append(line)
    return "\n".join(out)


# --- formulas
def clean_latex(latex: Column) -> Column:
    """LaTeX as a model writes it without its shell: escapes, fences, delimiters and tags."""
    t = latex
    for control, letter in (("\t", "t"), ("\f", "f"), ("\b", "b"), ("\r", "r"), ("\x0b", "v"), ("\x07", "a")):
        t = F.regexp_replace(t, f"{re.escape(control)}(?=[A-Za-z])", "\\\\\\\\" + letter)
    twice = t.rlike(r"\\\\[A-Za-z]") & ~t.rlike(r"(?<!\\)\\(?!\\)[A-Za-z]")
    t = F.when(twice, F.replace(t, F.lit("\\\\"), F.lit("\\"))).otherwise(t)
    t = F.trim(F.regexp_replace(F.trim(t), r"(?s)^```(?:latex|tex|math)?\s*\n?(.*?)\n?```$", "$1"))
    for pattern in (r"(?s)^\$\$(.+)\$\$$", r"(?s)^\\\[(.+)\\\]$", r"(?s)^\\\((.+)\\\)$", r"(?s)^\$(.+)\$$"):
        t = F.trim(F.regexp_replace(t, pattern, "$1"))
    return F.trim(F.regexp_replace(t, r"\\tag\s*\{[^}]*\}", ""))


def renderable(latex: Column) -> Column:
    """Whether LaTeX may stand in a text: not empty or longer than 4,000, braces even, no control characters."""
    count = lambda c: F.length(F.regexp_replace(latex, f"[^{c}]", ""))
    return (F.coalesce(latex, F.lit("")) != "") & (F.length(latex) <= 4000) & (count(r"\{") == count(r"\}")) & ~latex.rlike(r"[\x00-\x09\x0b-\x1f]")


def formula_block(latex: Column, kind: Column, number: Column, name: Column, file: Column) -> Column:
    """A formula in markdown, by its kind; without LaTeX its picture."""
    wrap = lambda a, b: F.concat(F.lit(a), latex, F.lit(b))
    tagged = F.concat(F.lit("$$"), latex, F.lit(" \\tag{"), number, F.lit("}$$"))
    return (
        F.when(F.coalesce(latex, F.lit("")) == "", F.concat(F.lit("!["), name, F.lit("]("), file, F.lit(")"))).when(kind == "code", wrap("```\n", "\n```")).when(kind == "text", latex)
        .when(kind == "inline", wrap("$", "$")).otherwise(F.when(F.coalesce(number, F.lit("")) != "", tagged).otherwise(wrap("$$", "$$")))
    )


def placed_formulas(rows: DataFrame, records: DataFrame, mark: str = "<!-- formula-not-decoded -->") -> DataFrame:
    """Lines with the k-th mark of each document in the shape of its k-th record: doc_id, i, line.

    rows: doc_id, i, line; records: doc_id, slot (from 0), block, drop.  A mark
    whose record is dropped goes; one without a record stays.
    """
    is_mark = F.trim("line") == mark
    r = rows.withColumn("slot", F.when(is_mark, F.sum(is_mark.cast("int")).over(in_order("doc_id")) - 1))
    j = r.join(records.select("doc_id", "slot", "block", "drop"), ["doc_id", "slot"], "left")
    return j.where(~F.coalesce("drop", F.lit(False))).select("doc_id", "i", F.coalesce("block", "line").alias("line"))


def formula_records(items: DataFrame) -> DataFrame:
    """Formula regions as records: doc_id, slot, id, hint, number, drop.

    items: doc_id, slot, orig.  Regions of a number or a mark alone are dropped;
    their number goes to the formula before, if that has none.
    """
    flat = F.trim(F.regexp_replace(F.coalesce("orig", F.lit("")), r"\s+", " "))
    alone = F.regexp_extract(flat, r"^\(?([0-9]{1,3}[a-z]?)\)?$", 1)
    tail = F.regexp_extract(flat, r"\(([0-9]{1,3}[a-z]?)\)$", 1)
    hint = F.trim(F.regexp_replace(flat, r"\(([0-9]{1,3}[a-z]?)\)$", ""))
    r = items.select("doc_id", "slot", F.when(alone != "", alone).otherwise(tail).alias("number"), hint.alias("hint"), ((alone != "") | hint.rlike(r"^[.,;:]*$")).alias("drop"))
    w = in_order("doc_id", pos="slot")
    r = r.withColumn("of", F.sum((~F.col("drop")).cast("int")).over(w))
    first = F.first(F.nullif("number", F.lit("")), ignorenulls=True).over(Window.partitionBy("doc_id", "of").orderBy("slot").rowsBetween(0, Window.unboundedFollowing))
    r = r.withColumn("number", F.when(~F.col("drop"), F.coalesce(first, F.lit(""))).otherwise(""))
    return r.select("doc_id", "slot", F.when(~F.col("drop"), F.format_string("formula-%02d", "of")).alias("id"), "hint", "number", "drop")


def glyph_lines(glyphs: DataFrame) -> DataFrame:
    """Lines of glyphs: all columns and line, by baselines that are near and gaps that are not columns.

    glyphs: doc_id, page, pos, x, right, base, size.  A baseline is new if it
    is 0.15 of the median size away from the one before; a gap of 2.5 sizes
    starts another line.
    """
    whole = Window.partitionBy("doc_id", "page")
    g = glyphs.withColumn("_m", F.percentile("size", 0.5).over(whole))
    by_base = whole.orderBy("base", "x", "pos")
    g = g.withColumn("_row", F.sum((F.coalesce(F.col("base") - F.lag("base").over(by_base), F.lit(0.0)) > 0.15 * F.col("_m")).cast("int")).over(by_base))
    along = Window.partitionBy("doc_id", "page", "_row").orderBy("x", "pos")
    apart = (F.coalesce(F.col("x") - F.lag("right").over(along), F.lit(0.0)) > 2.5 * F.col("_m")).cast("int")
    g = g.withColumn("_part", F.sum(apart).over(along))
    return g.withColumn("line", F.dense_rank().over(whole.orderBy("_row", "_part"))).drop("_m", "_row", "_part")


def math_islands(glyphs: DataFrame) -> DataFrame:
    """Runs of glyphs in fonts of formulas within a line: doc_id, page, line, island, text, before, after.

    glyphs: as glyph_lines, with char and math.  before and after are the ten
    letters on either side.
    """
    g = glyph_lines(glyphs)
    w = Window.partitionBy("doc_id", "page", "line").orderBy("x", "pos")
    g = g.withColumns({"_new": (F.col("math") != F.coalesce(F.lag("math").over(w), ~F.col("math"))).cast("int"), "_n": F.row_number().over(w)})
    g = g.withColumn("_run", F.sum("_new").over(w))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "char"))), lambda x: x["char"]), "").alias(c)
    runs = g.groupBy("doc_id", "page", "line", "_run", "math").agg(text("text"))
    order = Window.partitionBy("doc_id", "page", "line").orderBy("_run")
    flat = F.regexp_replace("text", r"\s+", "")
    near = runs.withColumns({"before": F.coalesce(F.right(F.lag(flat).over(order), F.lit(10)), F.lit("")), "after": F.coalesce(F.left(F.lead(flat).over(order), F.lit(10)), F.lit(""))})
    return near.where("math").select("doc_id", "page", "line", F.col("_run").alias("island"), "text", "before", "after")


def placed_islands(text: str, islands: list[tuple[str, str, str, str]]) -> str:
    """A text with islands (text, before, after, latex) as inline formulas where their context is unique.

    Contexts are tried from long to short; after that the first place behind
    the last one that was filled counts, if eight letters of context are there.
    """
    cursor = 0
    for plain, before, after, latex in islands:
        flat = lambda t: "".join(t.split())
        own = r"\s*".join(map(re.escape, flat(plain)))
        for k, n in ((10, 10), (6, 6), (10, 0), (0, 10)):
            left, right = flat(before)[len(flat(before)) - k :] if k else "", flat(after)[:n]
            if len(left) + len(right) < min(8, k + n):
                continue
            spaced = lambda t: r"\s*".join(map(re.escape, t))
            found = list(re.finditer(f"({spaced(left)}\\s*)({own})(?=\\s*{spaced(right)})", text))
            later = [m for m in found if m.start() >= cursor]
            m = found[0] if len(found) == 1 else later[0] if later and (k, n) == (10, 10) else None
            if m:
                new = f"${latex}$"
                text = text[: m.start(2)] + new + text[m.end(2) :]
                cursor = m.start(2) + len(new)
                break
    return text


def aligned_blocks(blocks: list[str], items: list[str], least: int = 24) -> list[int | None]:
    """The item of each block, both in order: equal letters and digits, or one begins the other from `least` on; None where unsure."""
    import html

    key = lambda t: re.sub(r"[^a-z0-9]+", "", html.unescape(t or "").lower())
    keys, at, out = [key(t) for t in items], 0, []
    for b in map(key, blocks):
        fits = lambda k: k and (k == b or min(len(b), len(k)) >= least and (k.startswith(b) or b.startswith(k)))
        hit = next((j for j in range(at, len(keys)) if fits(keys[j])), None) if b else None
        out.append(hit)
        at = at if hit is None else hit + 1
    return out


def align_blocks(blocks: DataFrame, items: DataFrame) -> DataFrame:
    """aligned_blocks for every document: doc_id, block, item.  blocks: doc_id, block, text; items: doc_id, item, text."""
    gather = lambda df, pos, name: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(pos, "text"))).alias(name))
    j = gather(blocks, "block", "b").join(gather(items, "item", "t"), "doc_id", "left").select("doc_id", "b", F.coalesce("t", F.array()).alias("t"))
    text = lambda c: F.transform(c, lambda x: x["text"])

    @F.pandas_udf("array<int>")
    def run(b: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([aligned_blocks(list(x), list(y)) for x, y in zip(b, t, strict=True)], dtype=object)

    found = j.withColumn("at", run(text("b"), text("t")))
    pairs = F.arrays_zip(F.transform("b", lambda x: x["block"]).alias("block"), F.transform("at", lambda a: F.get("t", a)["item"]).alias("item"))
    return found.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.block", "p.item")


def repair(docs: DataFrame, how: Callable[..., str], *columns: str, out: str = "text") -> DataFrame:
    """docs with `out` as one of this module's functions makes it of the given columns."""

    plain = lambda v: list(v) if hasattr(v, "__len__") and not isinstance(v, str) else v

    @F.pandas_udf("string")
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if x[0] is None else how(*map(plain, x)) for x in zip(*cols, strict=True)])

    return docs.withColumn(out, run(*columns))
