"""Stemming analysers: stop words and suffix stripping by the published Snowball rules for English, Italian, Spanish.

A word is a state: its letters and the places where its regions begin. Rules look at the longest ending of a set and
act if it lies in the region asked for. Stemming is meant for a table of distinct terms, see `operators.lexical.stemmed`.
"""

from __future__ import annotations

import re
from collections.abc import Callable

# Stop words. The Italian and Spanish ones are those of articles, prepositions, pronouns and auxiliaries.
STOP = {
    "english": (
        "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
        "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
        "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
        "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
    ),
    "italian": (
        "ad al allo ai agli all agl alla alle con col coi da dal dallo dai dagli dall dagl dalla dalle di del dello dei degli dell degl della delle in nel nello nei negli nell negl "
        "nella nelle su sul sullo sui sugli sull sugl sulla sulle per tra contro io tu lui lei noi voi loro mio mia miei mie tuo tua tuoi tue suo sua suoi sue nostro nostra nostri "
        "nostre vostro vostra vostri vostre mi ti ci vi lo la li le gli ne il un uno una ma ed se perché anche come dov dove che chi cui non più quale quanto quanti quanta quante "
        "quello quelli quella quelle questo questi questa queste si tutto tutti a c e i l o ho hai ha abbiamo avete hanno sono sei è siamo siete era erano fu furono"
    ),
    "spanish": (
        "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien "
        "desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual "
        "poco ella estar estas algunas algo nosotros mi mis tú te ti tu tus ellas nosotras vosotros vosotras os mío mía míos mías tuyo tuya tuyos tuyas suyo suya suyos suyas nuestro "
        "nuestra nuestros nuestras vuestro vuestra vuestros vuestras esos esas es soy eres somos sois son era eran fue fueron ha he has han había"
    ),
}


def ending(word: str, endings: frozenset[str], at: int = 0) -> str:
    """The longest of the endings that the word has at or after `at`, or ''."""
    if word[-2:] not in _tails(endings):
        return ""
    for i in range(max(at, len(word) - _longest(endings)), len(word)):
        if word[i:] in endings:
            return word[i:]
    return ""


_sizes: dict[frozenset[str], int] = {}
_last: dict[frozenset[str], frozenset[str]] = {}


class _All(frozenset):
    def __contains__(self, _: object) -> bool:
        return True


def _tails(endings: frozenset[str]) -> frozenset[str]:
    """The last two letters of all endings, by which most words are told to have none; everything if one is shorter."""
    if endings not in _last:
        _last[endings] = frozenset(e[-2:] for e in endings) if all(len(e) > 1 for e in endings) else _All()
    return _last[endings]


def _longest(endings: frozenset[str]) -> int:
    if endings not in _sizes:
        _sizes[endings] = max(map(len, endings))
    return _sizes[endings]


_regions: dict[str, re.Pattern] = {}


def region(word: str, vowels: str, at: int = 0) -> int:
    """Where the part begins that follows the first consonant after a vowel, from `at` on."""
    if vowels not in _regions:
        _regions[vowels] = re.compile(f"[^{vowels}]*[{vowels}]+[^{vowels}]")
    found = _regions[vowels].match(word, at)
    return found.end() if found else len(word)


def _set(text: str) -> frozenset[str]:
    return frozenset(text.split())


# -- English

_V = "aeiouy"
_IRREGULAR = dict(p.split(":") for p in "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes".split())
_KEPT = _set("inning outing canning herring earring proceed exceed succeed")
_SHORT = re.compile(f"(?:[^{_V}][{_V}][^{_V}wxY]|^[{_V}][^{_V}])$").search
_VOWEL = re.compile(f"[{_V}]").search
_PAST = _set("eed eedly ed edly ing ingly")
_STEP2 = dict(
    p.split(":")
    for p in "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble fulli:ful lessli:less ogi:og li:".split()
)
_STEP3 = dict(p.split(":") for p in "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness: ative:".split())
_STEP4 = _set("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion")
_IN2, _IN3 = frozenset(_STEP2), frozenset(_STEP3)


def english(word: str) -> str:
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = re.sub(f"([{_V}])y", r"\1Y", re.sub("^y", "Y", word)) if "y" in word else word
    first = re.match("gener|commun|arsen", w) if w[0] in "gca" else None
    r1 = first.end() if first else region(w, _V)
    r2 = region(w, _V, r1)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL(w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    end = ending(w, _PAST)
    rest = w[: len(w) - len(end)]
    if end in ("eed", "eedly"):
        w = rest + "ee" if len(rest) >= r1 else w
    elif end and _VOWEL(rest):
        if rest.endswith(("at", "bl", "iz")):
            w = rest + "e"
        elif rest[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            w = rest[:-1]
        else:
            w = rest + "e" if len(rest) == r1 and _SHORT(rest) else rest
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for step, endings in ((_STEP2, _IN2), (_STEP3, _IN3)):
        end = ending(w, endings)
        rest = w[: len(w) - len(end)]
        if not end or len(rest) < r1 or (end == "ogi" and rest[-1:] != "l") or (end == "li" and rest[-1:] not in tuple("cdeghkmnrt")) or (end == "ative" and len(rest) < r2):
            continue
        w = rest + step[end]
    end = ending(w, _STEP4)
    rest = w[: len(w) - len(end)]
    if end and len(rest) >= r2 and (end != "ion" or rest[-1:] in ("s", "t")):
        w = rest
    rest = w[:-1]
    if (w[-1:] == "e" and (len(rest) >= r2 or (len(rest) >= r1 and not _SHORT(rest)))) or (w[-2:] == "ll" and len(rest) >= r2):
        w = rest
    return w.replace("Y", "y")


# -- Italian and Spanish: regions alike, and rules of three kinds


def _verb_region(w: str, vowels: str) -> int:
    """Behind the next vowel if the second letter is a consonant, behind the next consonant if the word begins with two
    vowels, else behind the third letter."""
    if len(w) < 2:
        return len(w)
    if w[1] not in vowels:
        found = re.compile(f"[{vowels}]").search(w, 2)
        return found.end() if found else len(w)
    if w[0] in vowels:
        found = re.compile(f"[^{vowels}]").search(w, 2)
        return found.end() if found else len(w)
    return min(3, len(w))


def _cut(w: str, endings: tuple[str, ...], at: int) -> str:
    """Without the first of the endings that it has, if that lies at or after `at`."""
    for e in endings:
        if w.endswith(e):
            return w[: -len(e)] if len(w) - len(e) >= at else w
    return w


_VS = "aeiouáéíóúü"
_ACUTE = str.maketrans("áéíóú", "aeiou")
_S_PRONOUN = _set("me se sela selo selas selos la le lo las les los nos")
_S_PLAIN = _set("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos")
_S_IC = _set("adora ador ación adoras adores aciones ante antes ancia ancias")
_S_OTHER = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
_S_ALL = _S_PLAIN | _S_IC | frozenset(_S_OTHER) | _set("amente mente idad idades iva ivo ivas ivos")
_S_Y = _set("ya ye yan yen yeron yendo yo yó yas yes yais yamos")
_S_GU = _set("en es éis emos")
_S_VERB = _S_GU | _set(
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais "
    "aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
)
_S_LAST = _set("os a o á í ó e é")


def spanish(w: str) -> str:
    rv, r1 = _verb_region(w, _VS), region(w, _VS)
    r2 = region(w, _VS, r1)
    pronoun = ending(w, _S_PRONOUN, rv)
    rest = w[: len(w) - len(pronoun)]
    if pronoun:
        accented, plain = ending(rest, _set("iéndo ándo ár ér ír"), rv), ending(rest, _set("ando iendo ar er ir yendo"), rv)
        if accented:
            w = rest[: len(rest) - len(accented)] + accented.translate(_ACUTE)
        elif plain and (plain != "yendo" or rest[:-5].endswith("u")):
            w = rest
    before = w
    end = ending(w, _S_ALL)
    rest = w[: len(w) - len(end)]
    if end == "amente":
        if len(rest) >= r1:
            w = _cut(rest, ("iv", "os", "ic", "ad"), r2)
            w = _cut(w, ("at",), r2) if w != rest and rest.endswith("iv") else w
    elif end and len(rest) >= r2:
        more = ("ic",) if end in _S_IC else ("ante", "able", "ible") if end == "mente" else ("abil", "ic", "iv") if end.startswith("idad") else ("at",) if end.startswith("iv") else ()
        w = rest + _S_OTHER[end] if end in _S_OTHER else _cut(rest, more, r2)
    if w == before:
        end = ending(w, _S_Y, rv)
        if end and w[: -len(end)].endswith("u"):
            w = w[: -len(end)]
        else:
            end = ending(w, _S_VERB, rv)
            if end:
                w = w[: -len(end)]
                w = w[:-1] if end in _S_GU and w.endswith("gu") else w
    end = ending(w, _S_LAST, rv)
    if end:
        w = w[: -len(end)]
        w = w[:-1] if end in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv else w
    return w.translate(_ACUTE)


_VI = "aeiouàèìòù"
_GRAVE = str.maketrans("áéíóú", "àèìòù")
_I_PRONOUN = _set("ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene")
_I_PLAIN = _set("anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti")
_I_IC = _set("azione azioni atore atori")
_I_OTHER = {"logia": "log", "logie": "log", "uzione": "u", "uzioni": "u", "usione": "u", "usioni": "u", "enza": "ente", "enze": "ente"}
_I_RV = _set("amento amenti imento imenti")
_I_ALL = _I_PLAIN | _I_IC | frozenset(_I_OTHER) | _I_RV | _set("amente ità ivo ivi iva ive")
_I_VERB = _set(
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò "
    "erono essero ete eva evamo evano evate evi evo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva "
    "ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir Yamo"
)


def italian(word: str) -> str:
    w = word.translate(_GRAVE).replace("qu", "qU")
    w = re.sub(f"(?<=[{_VI}])([ui])(?=[{_VI}])", lambda m: m[0].upper(), w)
    rv, r1 = _verb_region(w, _VI), region(w, _VI)
    r2 = region(w, _VI, r1)
    pronoun = ending(w, _I_PRONOUN)
    rest = w[: len(w) - len(pronoun)]
    verb = ending(rest, _set("ando endo ar er ir"), rv) if pronoun else ""
    if verb:
        w = rest if len(verb) > 2 else rest + "e"
    before = w
    end = ending(w, _I_ALL)
    rest = w[: len(w) - len(end)]
    if end == "amente":
        if len(rest) >= r1:
            w = _cut(rest, ("iv", "abil", "os", "ic"), r2)
            w = _cut(w, ("at",), r2) if w != rest and rest.endswith("iv") else w
    elif end in _I_RV:
        w = rest if len(rest) >= rv else w
    elif end and len(rest) >= r2:
        more = ("ic",) if end in _I_IC else ("abil", "ic", "iv") if end == "ità" else ("at",) if end in ("ivo", "ivi", "iva", "ive") else ()
        w = rest + _I_OTHER[end] if end in _I_OTHER else _cut(rest, more, r2)
        w = _cut(w, ("ic",), r2) if w != rest and more == ("at",) else w
    if w == before:
        end = ending(w, _I_VERB, rv)
        w = w[: len(w) - len(end)]
    if w and w[-1] in "aeioàèìò" and len(w) - 1 >= rv:
        w = w[:-1]
        w = w[:-1] if w.endswith("i") and len(w) - 1 >= rv else w
    if w.endswith(("ch", "gh")) and len(w) - 1 >= rv:
        w = w[:-1]
    return w.replace("I", "i").replace("U", "u")


STEMMERS: dict[str, Callable[[str], str]] = {"english": english, "italian": italian, "spanish": spanish, "simple": lambda w: w}


def analyser(name: str, stop: frozenset[str] | None = None) -> Callable[[str], str | None]:
    """The stem of a lower-cased word, or None for a stop word, by one of the allowed names. `stop` replaces the list."""
    if name not in STEMMERS:
        raise ValueError(f"no analyser {name!r}; there are {', '.join(sorted(STEMMERS))}")
    stop, stem = _set(STOP.get(name, "")) if stop is None else stop, STEMMERS[name]
    return lambda w: None if w in stop else stem(w)
