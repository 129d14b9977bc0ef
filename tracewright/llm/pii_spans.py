"""Candidate spans of personal data in a text, with the votes of the labelers on each.

A labeler looks at one thing only (form, word list, words before, words after, look-alikes) and
votes 1 (personal), -1 (not) or 0 (no opinion). No labeler decides; see ``pii``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field

LABELERS = 5  # form, list, before, after, look-alike
TYPES = ["email", "phone", "id_number", "street_address", "person_name"]


@dataclass
class Span:
    """A candidate: characters [start, end) of a text, its type, the labelers' votes, and words for the classifier."""

    start: int
    end: int
    kind: str
    votes: tuple[int, ...]
    features: list[str] = field(default_factory=list)


# --- word lists (fixed values) ---------------------------------------------------------------

TITLES = "Mr Mrs Ms Miss Mx Dr Prof Sir Herr Frau Mme Mlle Sr Sra Dott Ing".split()
PARTICLES = "van von der den de del della di da du la le ter ten bin al".split()
STREET_WORDS = "street st road rd lane ln avenue ave boulevard blvd drive dr court ct close way place pl square sq terrace crescent row walk gardens grove hill mews parade quay".split()
STREET_PREFIXES = "rue calle via avenida avenue allée boulevard plaza place chemin impasse rua ulica".split()
STREET_ENDINGS = "straße strasse str. weg gasse allee platz ring damm ufer".split()
_TITLE_WORDS = {t.lower() for t in TITLES}
TECH_WORDS = "helm chart argo rollout main queue elastic error service cluster account build request serial ticket version subnet provider module window resource terraform kubernetes".split()

_MONTH = r"(?:19|20)\d\d-\d\d-\d\d"

# --- before and after, by type ---------------------------------------------------------------

_BEFORE = {
    "email": r"(?:ask|contact:?\"?:? ?\"?|mail(?:to)?:?|sent to|approved by|escalate to .*\(|owner = \"|user=|<|\(|cc|from|to)\s*\"?$",
    "phone": r"(?:call|phone|tel\.?:?|whatsapp|mobile|fax|reachable under|reach .* (?:at|on)|sms(?: to)?|dial|pager=|\"on-?call\": ?|escalation|[/,]|^|\n)\s*\"?$",
    "id_number": r"(?:ssn|social[ _]security[ _](?:number|no\.?)|nino|national[ _]insurance[ _](?:no\.?|number)|passport(?:[ _](?:no\.?|number))?|id[ _]card|identity[ _]card|dni|nie|personal[ _]identity[ _]number|tax[ _]id|driving[ _]licen[cs]e)(?: ?[:=(]| was| is)?\s*[(\"]*$",
    "street_address": r"(?:site is|stands at|goes to|ships to|location ?[=:]|address(?: is|:)?|lives at|deliver(?:ed)? to|office at|moved to)\s*\"?$",
    "person_name": r"(?:spoke (?:to|with)|reviewed(?: by|:)?|paired with|handed over to|thanks to|reported by|escalate to|approved by|asked|user=\"|contact:?|owner:?|author:?|cc:?|by:?|--|as|signed|from|(?:mr|mrs|ms|miss|mx|dr|prof|herr|frau)\.?)\s*$",
}
_AFTER = {
    "email": r"^(?:>|\)|,|\.|\"|;| before| for| has| failed| msg|$|\n)",
    "phone": r"^(?:\)|,|\.(?!\d)|;| after| if| ask|$|\n| [-(/])",
    "id_number": r"^\)?(?: was| from| in | is|\.(?!\d)|$|\n|,|;|\")",
    "street_address": r"^(?:\.|;|$|\n|\)|\"| -|,)",
    "person_name": r"^(?:'s|’s| confirmed| about| on (?:this|[A-Z]\w+day)| for the| said| <| \(|\"|\.|,|;|$|\n)",
}
_LOOK_ALIKE_BEFORE = {
    "email": r"(?:git|svn|hg|ssh|clone[d]? from|https?://\S*|provider@?)$",
    "phone": r"(?:account|build|request(?: id)?|serial|ticket|version|port|status|arn:\S*|change|subnet|address|step|order|incident|id[ =:]|ssn|dni|passport|identity number|::|(?:ssn|dni|nino|number|no\.?|passport|card)[:=( ]+\"?)\s*#?$",
    "id_number": r"(?:account|build|request(?: id)?|serial|ticket|version|call|phone|tel:?|change|commit)\s*#?$",
    "street_address": r"(?:moved|subnet|of|about|had)\s*$",
    "person_name": r"(?:^|\W)(?:the|a|an|no|each|every|new)\s*$",
}
_LOOK_ALIKE_AFTER = {
    "email": r"^(?::[\w/.-]+|/)",
    "phone": r"^(?:[-/:.]?\w|:)",
    "id_number": r"^(?:-?\w|\.\d)",
    "street_address": r"^ (?:entries|of|runs)",
    "person_name": r"^(?:-\w|_| (?:is the nickname|cluster|queue|entries|and Argo|were|service|runner|was not))",
}
_BEFORE, _AFTER = ({k: re.compile(p, re.I) for k, p in d.items()} for d in (_BEFORE, _AFTER))
_LOOK_ALIKE_BEFORE, _LOOK_ALIKE_AFTER = ({k: re.compile(p, re.I) for k, p in d.items()} for d in (_LOOK_ALIKE_BEFORE, _LOOK_ALIKE_AFTER))

# --- forms -----------------------------------------------------------------------------------

_AT = r"(?:@|\s?[(\[{]\s?at\s?[)\]}]\s?|\sat\s)"
_DOT = r"(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s)"
_EMAIL = re.compile(rf"(?<![\w.+%@*-])[A-Za-z0-9][\w.+%'-]*{_AT}[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w-])", re.I)
_ANY_AT = re.compile(_AT, re.I)
_PLAIN_AT = re.compile(r"\sat\s", re.I)
_SPELLED_DOT = re.compile(r"\sdot\s|[(\[{]\s?dot", re.I)

_PHONE = re.compile(r"(?<![\w.+/-])(?:\+|\(?0|\(?\d)(?:[\d()]|[ .\-](?=[\d(])){7,20}\d(?![\d])")
_PHONE_FORM = re.compile(
    r"(?:\+\d{1,3}[ .-]?(?:\(0\))?(?:[ .-]?\(?\d{1,5}\)?){2,6}"
    r"|00 ?\d{2}(?: \d{1,4}){2,5}"
    r"|0\d{1,4}(?: \d{2,6}){1,4}"
    r"|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4}"
    r"|1\d{10})"
)
_ID = re.compile(
    r"(?<![\w.-])(?:[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-Z]|[A-Z]{2}-\d{3}\.\d{3}\.\d{3}|[A-Z]{1,2}\d{6,8}|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]"
    r"|\d{3}[- ]\d{2}[- ]\d{4}|\d{6}-\d{4}|\d{9,12})(?![\w])"
)
_CAP = r"[A-ZÄÖÜÉÈÀÇÑ][\w'’ß]*"
_PLACE = rf"{_CAP}(?:[ -]{_CAP}){{0,2}}"
_TYPES_RE = "|".join(sorted((re.escape(w) for w in STREET_WORDS), key=len, reverse=True))
_PRE_RE = "|".join(STREET_PREFIXES)
_END_RE = "|".join(re.escape(w) for w in STREET_ENDINGS)
_CODE = r"(?:[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}|\d{4,5})"
_FLAT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Floor|Room)\s\w+"
_STREET = (
    rf"(?:\d+[a-z]?,? (?:{_CAP} ){{1,3}}(?:(?i:{_TYPES_RE}))\b(?:\.(?=,))?"
    rf"|\d+[a-z]?,? (?i:{_PRE_RE}) {_PLACE}"
    rf"|(?i:{_PRE_RE}) {_PLACE} \d+[a-z]?"
    rf"|(?:{_CAP} ){{0,2}}{_CAP}(?:(?i:{_END_RE})) \d+[a-z]?)"
)
_ADDRESS = re.compile(rf"(?<![\w.,/-])(?:{_FLAT}, )?{_STREET}(?P<tail>(?:, {_FLAT})?(?:(?:,? |\n){_CODE} {_PLACE}|(?:, |\n){_PLACE},? {_CODE}(?!\w)|, (?P<town>{_PLACE}))?)(?!\w)")
_TOWN_AND_CODE = re.compile(rf"(?:{_CODE} (?P<a>{_PLACE})|(?:, |\n)(?P<b>{_PLACE}),? {_CODE})$")

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TITLE = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\b\.?[ \n]", re.I)


#: Words that a list of names may hold; other words are never like a name.
LISTABLE = re.compile("[a-z]{3,}")
_RUN = re.compile(r"[^\W\d_]+")
_LOCAL = re.compile(r"(?<![\w.+-])([a-z]{3,})[._-]((?:vander)?o?[a-z]{4,})(?:\+\w+)?@", re.I)


def names_in_emails(text: str) -> list[tuple[str, str]]:
    """Given and family names that addresses of two words spell out."""
    return [(m[1].lower(), m[2].lower()) for m in _LOCAL.finditer(text)]


def fold(word: str) -> str:
    """Lower case without accents."""
    if word.isascii():
        return word.lower()
    return "".join(ch for ch in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(ch))


class Gazetteer:
    """Names of people, known and made of known parts, and towns.

    A word is like a name if it is listed, or joins a beginning and an ending that listed names share.
    """

    def __init__(self, given: set[str], family: set[str], towns: set[str]) -> None:
        self.given, self.family, self.towns = given, family, towns
        self.seen: dict[tuple[str, str], int] = {}
        self._parts = {True: self._shared(given), False: self._shared(family)}
        self._known: dict[tuple[str, bool], bool] = {}

    @classmethod
    def told(cls, known: Iterable[str] | None) -> Gazetteer:
        """For one text, from what was looked up for it: list (g, f, t), count (2 for more, 0 for made of parts), word."""
        lists: dict[str, set[str]] = {"g": set(), "f": set(), "t": set()}
        out = cls(set(), set(), set())
        for k in () if known is None else known:
            lists[k[0]].add(k[2:])
            out.seen[k[0], k[2:]] = int(k[1])
        out.given, out.family, out.towns = lists["g"], lists["f"], lists["t"]
        return out

    def count(self, kind: str, word: str) -> str:
        """How often a word was counted for list ``kind``, as a feature: 0, 1, 2 (or more); '' where that is unknown."""
        w = fold(word).replace("’", "'")
        parts = [p.removeprefix("o'") for p in w.split("-")] if kind == "f" else [w]
        found = [self.seen[kind, p] for p in parts if (kind, p) in self.seen]
        return str(min(found)) if len(found) == len(parts) else ""

    @staticmethod
    def _shared(names: set[str]) -> tuple[set[str], set[str]]:
        heads: dict[str, set[str]] = {}
        tails: dict[str, set[str]] = {}
        for n in names:
            for i in range(2, len(n) - 1):
                heads.setdefault(n[:i], set()).add(n[i:])
                tails.setdefault(n[i:], set()).add(n[:i])
        return {h for h, t in heads.items() if len(t) > 1}, {t for t, h in tails.items() if len(h) > 1}

    def like(self, word: str, given: bool) -> bool:
        """Whether a word is like a given (else family) name."""
        key = (word, given)
        got = self._known.get(key)
        if got is None:
            if len(self._known) > 200_000:
                self._known.clear()
            got = self._known[key] = self._like(fold(word), given)
        return got

    def _like(self, w: str, given: bool) -> bool:
        if not given and "-" in w:
            return all(self._like(p, given) for p in w.split("-"))
        w = w.replace("’", "'")
        if not given and w.startswith("o'"):
            w = w[2:]
        if w in (self.given if given else self.family):
            return True
        heads, tails = self._parts[given]
        return len(w) >= 5 and any(w[:i] in heads and w[i:] in tails for i in range(2, len(w) - 1))


def _vote(ok: bool, no: bool = False) -> int:
    return 1 if ok else (-1 if no else 0)


def _span(text: str, start: int, end: int, kind: str, form: int, listed: int) -> Span:
    left, right = text[max(0, start - 60) : start], text[end : end + 30]
    votes = (
        form,
        listed,
        _vote(bool(_BEFORE[kind].search(left))),
        _vote(bool(_AFTER[kind].search(right))),
        -1 if _LOOK_ALIKE_BEFORE[kind].search(left) or _LOOK_ALIKE_AFTER[kind].search(right) else 0,
    )
    before = re.findall(r"\w+|[^\w\s]", left.lower())[-2:]
    after = re.findall(r"\w+|[^\w\s]", right.lower())[:1]
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[a-zà-ÿ]", "x", re.sub(r"[A-ZÀ-Þ]", "X", re.sub(r"\d", "9", text[start:end]))))[:24]
    return Span(start, end, kind, votes, [f"b1={before[-1] if before else ''}", f"b2={' '.join(before)}", f"a1={after[0] if after else ''}", f"s={shape}"])


def may_have_email(text: str) -> bool:
    """Whether a text has anything that stands between the halves of an address."""
    return "@" in text or bool(_ANY_AT.search(text))


def _emails(text: str, gaz: Gazetteer) -> list[Span]:
    out = []
    for m in _EMAIL.finditer(text):
        whole = m[0]
        spelled = bool(_PLAIN_AT.search(whole))
        if spelled and not _SPELLED_DOT.search(whole):
            continue  # "at" as a word needs a "dot" as a word
        local = re.split(_AT, whole, maxsplit=1, flags=re.I)[0]
        named = any(gaz.like(w, g) or gaz.like(w[1:], False) for w in re.findall(r"[^\W\d_]+", local) for g in (True, False))
        out.append(_span(text, m.start(), m.end(), "email", _vote(True, False), _vote(named, local.lower() in ("git", "svn", "hg", "root", "noreply"))))
    return out


def _phones(text: str) -> list[Span]:
    out = []
    for m in _PHONE.finditer(text):
        s, whole = m.start(), m[0]
        f = _PHONE_FORM.fullmatch(whole)
        if not f and (f := _PHONE_FORM.match(whole)) and not whole[f.end() : f.end() + 1].isdigit():
            whole = f[0]
        digits = sum(ch.isdigit() for ch in whole)
        good = bool(f) and 9 <= digits <= 15
        dated = bool(re.search(_MONTH, whole)) or whole.count(".") == 3
        out.append(_span(text, s, s + len(whole), "phone", _vote(good, not good or dated), _vote(False, digits > (15 if whole.startswith(("00", "+")) else 13) or digits < 9 or dated)))
    return out


def _ids(text: str) -> list[Span]:
    out = []
    for m in _ID.finditer(text):
        sp = _span(text, m.start(), m.end(), "id_number", 0, 0)
        labelled = sp.votes[2] == 1
        bare = m[0].isdigit()
        out.append(Span(sp.start, sp.end, sp.kind, (_vote(not bare, False), _vote(labelled, not labelled), *sp.votes[2:]), sp.features))
    return out


def _addresses(text: str, gaz: Gazetteer) -> list[Span]:
    out = []
    for m in _ADDRESS.finditer(text):
        end = m.end()
        town = m["town"]
        known = 0
        if town:
            words = town.split(" ")
            n = next((k for k in range(len(words), 0, -1) if fold(" ".join(words[:k])) in gaz.towns), 0)
            end = m.start("town") + len(" ".join(words[:n])) if n else m.start("town") - 2
            known = 1 if n else 0
        elif m["tail"]:
            known = 1
        sp = _span(text, m.start(), end, "street_address", 1, known)
        if town and known and (seen := gaz.count("t", " ".join(words[:n]))):
            sp.features.append(f"n={seen}")
        out.append(sp)
    return out


def lookups(text: str) -> set[tuple[str, str]]:
    """All that ``candidates`` may ask a gazetteer about a text: ("name", word) and ("town", words), folded."""
    runs = set(_RUN.findall(text))
    for m in _EMAIL.finditer(text) if may_have_email(text) else ():
        runs |= {w[1:] for w in _RUN.findall(re.split(_AT, m[0], maxsplit=1, flags=re.I)[0])}
    out = {("name", w) for w in map(fold, runs) if LISTABLE.fullmatch(w)}
    for m in _ADDRESS.finditer(text) if any(ch.isdigit() for ch in text) else ():
        if m["town"]:
            words = m["town"].split(" ")
            out |= {("town", fold(" ".join(words[:k]))) for k in range(1, len(words) + 1)}
    return out


def towns_of(text: str) -> list[str]:
    """Towns that stand beside a post code in an address; the corpus's list of towns is made of them."""
    return [fold(t["a"] or t["b"]) for m in _ADDRESS.finditer(text) if (t := _TOWN_AND_CODE.search(m[0]))]


def _names(text: str, gaz: Gazetteer) -> list[Span]:
    words = []
    for m in _WORD.finditer(text):
        w = m[0]
        if w[-2:].lower() in ("'s", "’s"):
            w = w[:-2]
        words.append((m.start(), m.start() + len(w), w))
    titles = {m.end(): m.start() for m in _TITLE.finditer(text)}
    n = len(words)
    glue = lambda i, j: text[words[i][1] : words[j][0]]
    blank = lambda i, j: (g := glue(i, j)) == " " or (len(g) < 5 and g.strip(" \xa0") == "" and g != "")
    out = []

    def particles(i: int) -> int:
        """The index after particles that begin at word i."""
        while i < n and words[i][2].lower() in PARTICLES and i + 1 < n and blank(i, i + 1):
            i += 1
        return i

    def add(i: int, j: int, given: str | None, family: str) -> None:
        start, end = words[i][0], words[j][1]
        has_given = given is None or len(given) == 1 or gaz.like(given, True)
        has_family = gaz.like(family, False)
        tokens = [w for _, _, w in words[i : j + 1]]
        form = _vote(all(w[0].isupper() or w.lower() in PARTICLES for w in tokens))
        tech = any(w.lower() in TECH_WORDS for w in tokens)
        sp = _span(text, start, end, "person_name", form, _vote(has_given and has_family, not has_given and not has_family or tech))
        sp.features.append(f"t={int(given is None)}")
        if sp.votes[1] > 0:
            seen = [x for x in (gaz.count("f", family), gaz.count("g", given) if given is not None and len(given) > 1 else "") if x]
            sp.features += [f"n={min(seen)}"] if seen else []
        if not (form or sp.votes[1] > 0):
            return
        out.append(sp)

    def proper(i: int) -> bool:
        w = words[i][2]
        return w[0].isupper() and len(w) > 1 and fold(w) not in _TITLE_WORDS

    for i in range(n):
        start, _, w = words[i]
        if start in titles:
            j = particles(i)
            k = j + 1
            named = proper(j) or gaz.like(words[j][2], False)
            whole = named and k < n and blank(j, k) and gaz.like(words[k][2], False) and gaz.like(words[j][2], True)
            if named and not whole:
                add(i, j, None, words[j][2])
            if not whole:  # else a given name follows the title, and the name is found like any other
                continue
        if fold(w) in _TITLE_WORDS:
            continue
        likely = gaz.like(w, True) and len(w) > 2
        if likely or (proper(i) and i + 1 < n and proper(i + 1)):
            # given [initial] [particles] family
            j = i + 1
            if j < n and len(words[j][2]) == 1 and words[j][2].isalpha() and blank(i, j) and j + 1 < n and glue(j, j + 1) == ". ":
                j += 1
                ok = True
            else:
                ok = j < n and blank(i, j)
            k = particles(j) if ok else j
            if ok and k < n and (gaz.like(words[k][2], False) or (proper(i) and proper(k))):
                add(i, k, w, words[k][2])
        if len(w) == 1 and w.isupper() and i + 1 < n and glue(i, i + 1) == ". ":
            k = particles(i + 1)
            if k < n and (gaz.like(words[k][2], False) or proper(k)) and not (i and len(words[i - 1][2]) > 2 and blank(i - 1, i) and gaz.like(words[i - 1][2], True)):
                add(i, k, w, words[k][2])
        # family, given
        j = particles(i)
        if j < n and gaz.like(words[j][2], False) and j + 1 < n and glue(j, j + 1) == ", ":
            g = words[j + 1][2]
            single = len(g) == 1 and g.isupper() and text[words[j + 1][1] : words[j + 1][1] + 1] == "."
            if gaz.like(g, True) and not gaz.like(g, False) or single:
                prior = i and blank(i - 1, i) and (gaz.like(words[i - 1][2], True) or words[i - 1][2].lower() in PARTICLES)
                if not prior:
                    add(i, j + 1, g, words[j][2])
    return out


def candidates(text: str, gaz: Gazetteer) -> list[Span]:
    """All candidates of a text, which may overlap."""
    out = _names(text, gaz)
    if may_have_email(text):
        out += _emails(text, gaz)
    if any(ch.isdigit() for ch in text):
        out += _phones(text) + _ids(text) + _addresses(text, gaz)
    return out
