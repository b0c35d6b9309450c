"""Reading one transcript segment: its speaker labels and its spoken words.

Plain functions on strings, used row by row inside Arrow batches by ``turns``.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache
from itertools import islice

import regex

#: Fixed: hesitation sounds, compared in lower case without punctuation and with repeated letters cut to two.
HESITATIONS = frozenset("um umm uh uhh uhm er err erm mm mmm mhm hm hmm ah ahh eh ehm äh ähm öh öhm euh heu hein".split())
#: Fixed: hesitation sounds that are also words; they count as words only beside other words.
DOUBTFUL = frozenset(("em", "ben", "bah", "hum"))
#: Labels that name nobody.
NOBODY = frozenset(("", "unknown", "unknown speaker", "speaker unknown", "speaker", "none", "null", "n a", "na"))

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_VOICE = re.compile(r"<v(?:\.[^\s>]*)?\s+([^<>]+)>", re.I)
_CLOCK = r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_TIME = re.compile(rf"[\[(<【{{]\s*{_CLOCK}(?:\s*-->\s*{_CLOCK})?\s*[\])>】}}]|(?<![\w:.,]){_CLOCK}(?:\s*-->(?:\s*{_CLOCK})?)?(?![\w:])|-->")
_BRACKET = re.compile(r"\[([^\[\]]*)\]|\(([^()]*)\)|【([^【】]*)】|\{([^{}]*)\}|\*([^*\n]+)\*|<([^<>]*)>")
_COLON = re.compile(r"[:：]")
_BACKWARD_WORDS = regex.compile(r"(?r)\S+")
#: What a text without any of these has: nothing but spoken words of whoever speaks.
_SPECIAL = re.compile(r"[:：\[\](){}<>【】*&♪♫\x00]")
_WORD = re.compile(r"[^\W_]+(?:[-'’.,_][^\W_]+)*", re.UNICODE)
_LONG_DRAWN = re.compile(r"(.)\1{2,}")
_NUMBERED = re.compile(r"^(?:speaker|spk|spkr|s)\s*0*(\d+)$")


def plain_name(label: str) -> str:
    """Lower case words of a label, without accents' composition differences, punctuation and underscores."""
    return " ".join(re.sub(r"[^\w]|_", " ", unicodedata.normalize("NFC", label).casefold()).split())


def _near(a: str, b: str) -> bool:
    """One edit (insertion, deletion, substitution or swap of neighbours) apart, or equal."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :]


class Roster:
    """Resolves the spellings of one source's speakers: names in any order, initials, numbers, roles, small typos."""

    def __init__(self, speakers: list[tuple[int, str, str, str]]):
        exact: dict[str, set[int]] = {}
        numbers: dict[int, set[int]] = {}
        self.long: list[tuple[str, int]] = []
        for sid, name, role, diar in speakers:
            words = plain_name(name or "").split()
            forms = set()
            if words:
                first, last = words[0], words[-1]
                forms |= {" ".join(words), first, last}
                if len(words) > 1:
                    rest = " ".join(words[1:])
                    forms |= {f"{rest} {first}", f"{last} {first}", f"{first[0]} {last}", f"{first} {last[0]}", f"{first}{last}"}
            if role and plain_name(role):
                forms.add(plain_name(role))
            if diar and plain_name(diar):
                forms.add(plain_name(diar))
                if m := _NUMBERED.match(plain_name(diar)):
                    numbers.setdefault(int(m[1]), set()).add(sid)
            for form in forms:
                exact.setdefault(form, set()).add(sid)
            self.long += [(form, sid) for form in forms if len(form) >= 5]
        self.exact = {form: next(iter(ids)) for form, ids in exact.items() if len(ids) == 1}
        self.numbers = {n: next(iter(ids)) for n, ids in numbers.items() if len(ids) == 1}
        self.shared = {form for form, ids in exact.items() if len(ids) > 1}
        self.cache: dict[str, int | None] = {}
        #: Words before a colon that can belong to its label: those of the longest form, and some that no form has.
        self.reach = max([3, *(form.count(" ") + 1 for form in exact)]) + 2

    def resolve(self, label: str | None) -> int | None:
        """The speaker's id; None if the label names nobody or more than one speaker."""
        if not label:
            return None
        if label not in self.cache:
            if len(self.cache) > 5000:
                self.cache.clear()
            self.cache[label] = self._find(label)
        return self.cache[label]

    def _find(self, label: str) -> int | None:
        name = plain_name(label)
        bare = plain_name(re.sub(r"[(\[][^()\[\]]*[)\]]", " ", label))
        for form in dict.fromkeys((name, bare)):
            if form in NOBODY or form in self.shared:
                continue
            if form in self.exact:
                return self.exact[form]
            if m := _NUMBERED.match(form):
                return self.numbers.get(int(m[1]))
        for form in dict.fromkeys((bare, name)):
            if len(form) >= 5 and form not in NOBODY and form not in self.shared and not re.search(r"\d", form):
                found = {sid for known, sid in self.long if _near(form, known)}
                if len(found) == 1:
                    return found.pop()
        return None


@lru_cache(maxsize=4096)
def roster_of(packed: str) -> Roster:
    """A roster from its packed form: fields split by \\x1f, speakers by \\x1e."""
    rows = [x.split("\x1f") for x in packed.split("\x1e") if x]
    return Roster([(int(r[0]), r[1], r[2], r[3]) for r in rows])


def spoken_words(text: str) -> list[str]:
    """Words of a text without labels and markup, hesitation sounds left out."""
    return [w for w in _WORD.findall(text) if not is_hesitation(w)]


@lru_cache(maxsize=200_000)
def is_hesitation(word: str) -> bool:
    low = word.lower()
    return low in HESITATIONS or _LONG_DRAWN.sub(r"\1\1", low) in HESITATIONS


def has_words(text: str) -> bool:
    """Whether a text has a spoken word; hesitation sounds that are also words do not make one."""
    return any(not is_hesitation(m[0]) and m[0].lower() not in DOUBTFUL for m in _WORD.finditer(text))


def _clean(text: str) -> str:
    """Spoken text: hesitation sounds go with the punctuation that hangs on them, white space is collapsed."""
    out = []
    for token in text.replace("♪", " ").replace("♫", " ").split():
        if token.isalpha():
            if not is_hesitation(token):
                out.append(token)
            continue
        core = token.strip(".,…!?-–—;:>•\"“”")
        if core and is_hesitation(core):
            continue
        if not core and not out:
            continue
        if core or token in ("-", "–", "—"):
            out.append(token)
    return " ".join(out)


def _lead(body: str, at: int) -> int:
    """Where a mark of a new speaker (>>, a dash or a bullet) just before ``at`` begins; ``at`` if there is none."""
    end = at
    while end and body[end - 1].isspace():
        end -= 1
    start = end
    if end and body[end - 1] in "-–—•":
        start = end - 1
    elif end > 1 and body[end - 1] == ">" == body[end - 2]:
        while start and body[start - 1] == ">":
            start -= 1
    return start if start < end and (not start or body[start - 1].isspace()) else at


_MARKED = re.compile(r"^(?:>>+|[-–—•])\s*")


def _colon_labels(body: str, roster: Roster) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Labels before a colon as (from, to, speaker), and marked labels that name nobody as (from, to).

    The longest run of words of the line that ends at the colon and names a speaker is the label, however long the
    name is; a line begins at a line break, at what was read before (nulls), or behind the last label.
    """
    labels, nobody, line = [], [], 0
    before = 0
    for m in _COLON.finditer(body):
        line = max(line, body.rfind("\n", before, m.start()) + 1, body.rfind("\x00", before, m.start()) + 1)
        before = m.end()
        if m.end() < len(body) and not (body[m.end()].isspace() or body[m.end()] == "\x00" or m[0] == "：" or body[m.end()] in "<[(♪"):
            continue
        starts = [w.start() for w in islice(_BACKWARD_WORDS.finditer(body, line, m.start()), roster.reach)][::-1]
        names = [_MARKED.sub("", body[s : m.start()]) for s in starts]
        found = next(((s, sid) for s, name in zip(starts, names) if name and (sid := roster.resolve(name.strip())) is not None), None)
        if found is not None:
            labels.append((_lead(body, found[0]), m.end(), found[1]))
            line = m.end()
            continue
        # A marked label that names nobody is no speech either.
        for s, name in zip(starts, names):
            if (plain := plain_name(name)) and plain in NOBODY:
                nobody.append((_lead(body, s), m.end()))
                line = m.end()
                break
    return labels, nobody


def read_segment(text: str, speaker: str | None, roster: Roster) -> list[tuple[int | None, str]]:
    """The segment's stretches of spoken words as (speaker id or None for 'goes on', clean text), in order.

    Empty if it has no spoken word. A label counts if it names one speaker of the roster; other bracketed notes are
    sound annotations. A stretch without spoken words is dropped together with its label.
    """
    if not _SPECIAL.search(text):
        return [(roster.resolve(speaker), _clean(text))] if has_words(text) else []
    if "&" in text:
        text = html.unescape(text)
    labels: list[tuple[int, int, int]] = []  # from, to, speaker
    masked = list(text)

    def mask(a: int, b: int) -> None:
        masked[a:b] = "\x00" * (b - a)

    if ":" in text or "-->" in text:
        for m in _TIME.finditer(text):
            mask(*m.span())
    body = "".join(masked)
    if "<" in body:
        for m in _VOICE.finditer(body):
            sid = roster.resolve(m[1].strip())
            if sid is not None:
                labels.append((m.start(), m.end(), sid))
            mask(*m.span())
        body = "".join(masked)
    for m in _BRACKET.finditer(body):
        inner = next(g for g in m.groups() if g is not None)
        sid = None if m[0][0] in "*<" else roster.resolve(inner.strip().strip(":：").strip())
        end = m.end()
        if sid is not None:
            if (c := _COLON.match(body, end)):
                end = c.end()
            labels.append((m.start(), end, sid))
        mask(m.start(), end)
    body = "".join(masked)
    if _COLON.search(body):
        named, nobody = _colon_labels(body, roster)
        labels += named
        for a, b, *_ in [*named, *nobody]:
            mask(a, b)
        body = "".join(masked)
    body = _TAG.sub(lambda m: "\x00" * len(m[0]), body)
    labels.sort()
    edges = [0, *[a for a, _, _ in labels], len(body)]
    who: list[int | None] = [roster.resolve(speaker), *[sid for _, _, sid in labels]]
    out: list[tuple[int | None, str]] = []
    for sid, a, b in zip(who, edges, edges[1:]):
        part = body[a:b].replace("\x00", " ")
        if ">>" in part:
            part = re.sub(r"(?:^|(?<=\s))>>+", " ", part)
        if has_words(part):
            out.append((sid, _clean(part)))
    return out
