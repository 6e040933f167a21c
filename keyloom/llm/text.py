"""How a reader sees a post: rendering, words, quotes, signatures, sentences."""

from __future__ import annotations

import html
import re
import unicodedata

# Markup of HTML and of bulletin boards.
TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>|\[/?(?:quote|b|i|u|s|url|img|size|color|code|list|font|center|spoiler|\*)(?:[= ][^\[\]\n]*)?\]", re.S | re.I)
#: Characters that are never seen: format characters and combining marks.
UNSEEN = re.compile("[­͏؜᠋-᠎​-‏‪-‮⁠-⁤︀-️﻿̀-ͯ҃-҉֑-ֽً-ٟ᪰-᫿᷀-᷿⃐-⃿︠-︯]")
LINE_BREAK = re.compile(r"(?:[ \t\r\f\v]*\n[ \t>|]*)+")
GAP = re.compile(r"([\W_]+)")
BLANK = re.compile(r"\s")
SOFT, HARD = 1, 2


def folded(text: str) -> str:
    """Markup and entities resolved, case, accents and letter forms folded; line breaks become one \\x01."""
    if "<" in text or "[" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = UNSEEN.sub("", unicodedata.normalize("NFKD", text))
    text = text.casefold()
    if not text.isascii():
        text = UNSEEN.sub("", unicodedata.normalize("NFKD", text))
    return LINE_BREAK.sub("\x01", text)


def words_and_gaps(text: str, as_folded: bool = False) -> tuple[list[str], list[int]]:
    """Words of the rendered text and, for each, what stands before it.  ``as_folded``: the text has been folded.

    A gap is HARD if it holds a blank, hence separates words in any case, and
    SOFT if it is only punctuation, quote marks or a line break, which may
    stand within a word as well as between two.
    """
    parts = GAP.split(text if as_folded else folded(text))
    words: list[str] = []
    gaps: list[int] = []
    if parts[0]:
        words.append(parts[0])
        gaps.append(HARD)
    for gap, word in zip(parts[1::2], parts[2::2]):
        if word:
            gaps.append(HARD if gap == " " or not words or BLANK.search(gap) else SOFT)
            words.append(word)
    return words, gaps


def plain_words(text: str) -> list[str]:
    """Words of a clean text: blanks separate them, punctuation within one is dropped."""
    words, gaps = words_and_gaps(text)
    out: list[str] = []
    for w, g in zip(words, gaps):
        if g == HARD or not out:
            out.append(w)
        else:
            out[-1] += w
    return out


# How posts mark quotes and signatures.
QUOTE_TOKEN = re.compile(r"\[quote(?:[= ][^\]\n]*)?\]|\[/quote\]|<blockquote[^<>]*>|</blockquote\s*>", re.I)
WROTE = re.compile(r"^[> ]*\S+ wrote:\s*$")
NAMED = re.compile(r"^\([\w.\-]+\)\s*$")
LONE_BREAK = re.compile(r"(?<!\n)\n(?!\n)")
RULE_LINE = re.compile(r"^[ \t]*(?:--|_{3,}|-{5,}|={5,}|\*{5,})[ \t]*$|<hr\s*/?>", re.I | re.M)
BREAK = re.compile(r"<br\s*/?>|</?p\s*/?>|</?div[^<>]*>|</?li[^<>]*>", re.I)
CODE_OPEN = re.compile(r"(\[code\])|(<pre[^<>]*>)|(```)", re.I)
CODE_CLOSE = (re.compile(r"\[/code\]", re.I), re.compile(r"</pre>", re.I), re.compile("```"))
SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+")
#: Parts of a sentence's role: below the last rule of the post, alone on its line, its line wrapped in markup or
#: quote marks, and from there up whether it stands on the last line, the one before, the third from the end or above.
BELOW, ALONE, WRAPPED, LINE = 1, 2, 4, 8
ROLES = 32


def _runs_on(block: list[str]) -> bool:
    """Whether the last line is longer than the lines before it could be: with their next word, each would have been wider than it."""
    width = min((len(a) + 1 + len(b.lstrip(">| ").partition(" ")[0]) for a, b in zip(block, block[1:])), default=0)
    return len(block[-1]) >= max(width, 1 + max(map(len, block[:-1])))


def without_line_quotes(text: str) -> tuple[str, int]:
    """The text without quotes marked line by line, and how many it had.

    A block of ``>`` lines is a quote if it opens with "name wrote:", one of
    ``|`` lines if a line "(name)" follows.  In other blocks the author may go
    on behind the quoted words: a last line that runs beyond the width at which
    the lines before it were broken is kept, the others are quoted.
    """
    if ">" not in text and "|" not in text:
        return text, 0
    lines = text.split("\n")
    kept: list[str] = []
    quotes, i = 0, 0
    while i < len(lines):
        mark = lines[i][:1]
        if mark not in (">", "|"):
            kept.append(lines[i])
            i += 1
            continue
        j = i
        while j < len(lines) and lines[j][:1] == mark:
            j += 1
        quotes += 1
        named = WROTE.match(lines[i]) if mark == ">" else j < len(lines) and NAMED.match(lines[j])
        if named:
            i = j + (mark == "|")
            kept.append("")
            continue
        last = lines[j - 1]
        if j - i > 1 and _runs_on(lines[i:j]):
            kept.append(last.lstrip(">| "))
        else:
            kept.append("".join(m.group() for m in QUOTE_TOKEN.finditer(last) if m.group()[1] == "/"))
        i = j
    return "\n".join(kept), quotes


def without_quotes(text: str) -> tuple[str, int]:
    """The text without what it quotes, and how many quotes it had.

    Bracket and block quotes nest.  A quote that is never closed ends at the
    first lone line break behind it, other than one right after a nested quote.
    """
    text, quotes = without_line_quotes(text)
    marks = list(QUOTE_TOKEN.finditer(text)) if "[" in text or "<" in text else []
    if not marks:
        return text, quotes
    spans: list[tuple[int, int]] = []
    stack: list[int] = []
    for m in marks:
        if m.group()[1] != "/":
            stack.append(m.start())
            quotes += 1
        elif stack:
            start = stack.pop()
            spans.append((start, m.end()))
    for start in stack:
        opened = QUOTE_TOKEN.match(text, start)
        at = opened.end()
        for s, e in sorted(spans):
            if s >= start and not text[at:s].strip():
                at = e + (text[e : e + 1] == "\n")
        end = LONE_BREAK.search(text, at)
        spans.append((start, end.start() if end else len(text)))
    out: list[str] = []
    at = 0
    for s, e in sorted(spans):
        if s > at:
            out.append(text[at:s])
        at = max(at, e)
    out.append(text[at:])
    return "\n".join(out), quotes


def without_code(text: str) -> tuple[str, int]:
    """The text without code, and how many pieces it had.

    A mark that is never closed takes the rest of its line, or only itself if
    that is the last line, so that no words after a stray mark are lost.
    """
    if "[" not in text and "<" not in text and "```" not in text:
        return text, 0
    out: list[str] = []
    at, pieces = 0, 0
    open_ended: set[int] = set()
    while m := CODE_OPEN.search(text, at):
        kind = m.lastindex - 1
        close = None if kind in open_ended else CODE_CLOSE[kind].search(text, m.end())
        if close is None:
            open_ended.add(kind)
        out.append(text[at : m.start()])
        line = text.find("\n", m.end())
        at = close.end() if close else line if line >= 0 else m.end()
        pieces += 1
    return "\n".join([*out, text[at:]]), pieces


def own_sentences(text: str | None) -> tuple[list[str], dict]:
    """Sentences of the author's own words, and structure: quotes, rules, code, sentences, and the role of each sentence.

    A signature isn't told from other words here; the sentences' roles say
    where they stand and how they are marked up, and the model learns from the
    labels which roles and words mean nothing.
    """
    if not text:
        return [], {"quotes": 0, "rules": 0, "code": 0, "sentences": 0, "roles": []}
    bare, quotes = without_quotes(text)
    bare, code = without_code(bare)
    rules = 0
    if "--" in bare or "___" in bare or "=====" in bare or "*****" in bare or "<" in bare:
        parts = RULE_LINE.split(bare)
        rules = len(parts) - 1
        if rules:
            bare = "\n".join(parts[:-1]) + "\n\x03" + parts[-1]
    if "<" in bare:
        bare = BREAK.sub("\n", bare)
    found: list[str] = []
    roles: list[int] = []
    left, below = [], 0
    for line in bare.replace("\x00", " ").split("\n"):
        if line[:1] == "\x03":
            line, below = line[1:], BELOW
        line = line.strip()
        role = below
        if line[:1] in ("[", "<", '"', "“", "”") and line[-1:] in ("]", ">", '"', "“", "”"):
            role |= WRAPPED
        if "<" in line or "[" in line:
            line = TAG.sub(" ", line)
        if "&" in line:
            line = html.unescape(line)
        sentences = [x for x in map(str.strip, SENTENCE.split(line)) if x]
        if sentences:
            left.append((len(sentences), role | (ALONE if len(sentences) == 1 else 0)))
            found += sentences
    for k, (n, role) in enumerate(left):
        roles += [role + LINE * min(len(left) - 1 - k, 3)] * n
    return found, {"quotes": quotes, "rules": rules, "code": code, "sentences": len(found), "roles": roles}
