"""Personal information in free text, by weak supervision.

One pass over the texts finds candidate spans and lets labelers vote on each:
its format (regex), word lists (gazetteers), the words before, the words
after, and for names the company they keep in all texts. Names are proposed
with and without a list: listed given names in any form, and every run of
capitalised words that holds no function word. Expectation-maximisation over
the counts of all vote patterns estimates the labelers' reliabilities and how
often each kind of proposal is right, without labels; its posteriors train a
logistic span classifier, which decides. Only pattern counts, whose number the
votes bound, reach the driver.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.naming import GIVEN, NICKNAMES
from weftwork.session import durable

TYPES = ("email", "phone", "id_number", "address", "name")
LABELERS = ("format", "gazetteer", "before", "after", "company")
#: Ways of proposing a span; of names: 0 to 2 a listed given name first (as written, small letters, capitals), 3 last, 4 an initial, 5 a title or address, 6 capitals inside a sentence, 7 at its start.
SHAPES = 8
#: The share of each that is expected to be right before anything is counted.
HOPES = {"name": (0.6, 0.6, 0.6, 0.6, 0.6, 0.6, 0.3, 0.3)}
#: Spans with at least this probability count.
THRESHOLD = 0.5

# Kinds of street in English; before the name in French and Spanish; endings of German ones.
STREETS = "street st road rd avenue ave lane ln drive close crescent cres terrace parade court place boulevard blvd way square highway row grove gardens mews walk quay esplanade".split()
FRENCH = r"rue|avenue|av\.|boulevard|bd\.?|chemin|impasse|place|allée|quai|cours|route|passage|square"
SPANISH = r"Calle|C/|Avda\.?|Av\.|Avenida|Plaza|Pza\.?|Paseo|Camino|Carretera|Ronda|Travesía"
GERMAN = r"straße|strasse|str\.|weg|gasse|allee|platz|grund|ring|damm|ufer|steig|pfad|chaussee|graben|markt"

_U, _L = "A-ZÀ-ÖØ-ÞŁŚŻŹĆŃŠŽČ", r"[^\W\d_]"
_FAMILY = rf"[{_U}]{_L}+(?:['’]{_L}+)?(?:-[{_U}]{_L}+)?"
_AT = re.compile(r"@")
_BRACKETED = re.compile(r"[\[({] ?[aA][tT] ?[\])}]")
_SPOKEN = re.compile(r" at (?=[\w-]+ dot )")
_LOCAL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+\-]*( ?)$")
_DOMAIN = re.compile(r"( ?)[A-Za-z0-9][A-Za-z0-9\-]*(?:(?:\.| ?[\[({] ?dot ?[\])}] ?| dot )[A-Za-z0-9][A-Za-z0-9\-]*)*(?:\.| ?[\[({] ?dot ?[\])}] ?| dot )[A-Za-z]{2,}", re.I)
_RUN = re.compile(r"\d(?:[\d ().\-/]{5,}\d|\d{5,})")
_PHONE = re.compile(
    r"(?<![\w+.#/@\-])(?:"
    r"(?P<strong>\+\d{1,3}[ .\-]?\(0\)[ .\-]?\d{1,4}(?:[ .\-]\d{2,4}){1,4}|\+\d{1,3}(?:[ .\-]\(?\d{1,6}\)?){2,6}|\+\d{8,15}|00\d{2}(?:[ .\-]\d{2,5}){2,5}"
    r"|1[ .\-]\d{3}[ .\-]\d{3}[ .\-]\d{4}|\(\d{2,5}\) ?\d{3,4}[ .\-]?\d{3,4}|0\d{2,4}/\d{5,9}|0\d(?:[ .]\d{2}){4}|\d{3}[.\-]\d{3}[.\-]\d{4}|0\d{3} \d{3} \d{3,4}|0\d{2} \d{4} \d{4}|0\d{4} \d{5,6}|0\d{3} \d{6,8}|0\d{9})"
    r"|(?P<weak>0\d{10}|[2-9]\d{2}[2-9]\d{6}|\d{3} \d{3} \d{4}|\d{3}[ \-]\d{4}))(?![\w@]|[./\-]\d)"
)
_ID = re.compile(
    r"(?<![\w+.#/@\-])(?:"
    r"(?P<strong>\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{2} \d{3} \d{3} \d{3}|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]|QQ ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|[A-Z]{2}\d{6,8}|[A-Z]\d{2}[A-Z]\d{2}[A-Z]\d{2})"
    r"|(?P<weak>\d{3} \d{3} \d{3}|\d{9}|\d{11}|[A-Z]\d{7,9}))(?![\w@]|[./\-]\d)"
)
_LICENCE = re.compile(r"[A-Z]\d\d[A-Z]\d\d[A-Z]\d\d")
_DIGITS = re.compile(r"\d+")
# Addresses whose number comes first begin at a number, the others end at one; so only the surroundings of numbers are looked at.
_ENGLISH = re.compile(rf"\d{{1,5}}[a-zA-Z]?,? (?:{_L}+['’]?{_L}*\.? ){{1,3}}?(?:{'|'.join(STREETS)})\b(?:(?<=ave)\.|(?<=blvd)\.)?", re.I)
_UNIT = re.compile(r"(?<!\w)(?:unit|flat|apartment|apt\.?|suite|ste\.?) \d+[a-z]?(?:/|, ?| )\Z", re.I)
_FRENCH = re.compile(rf"\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:{FRENCH}) (?:de la |de l['’]|des |du |de |d['’])?[{_U}]{_L}+(?:[ \-][{_U}]{_L}+)*")
_TO_NUMBER = re.compile(
    rf"(?<!\w)(?P<s>(?P<box>(?:P\. ?O\. ?Box|[Pp][Oo] [Bb]ox|Post Office Box|Postfach|Apartado(?: de Correos)?|Boîte Postale|BP) )"
    rf"|(?:{SPANISH}|calle|avenida|plaza|paseo) ?(?:de la |de los |de las |del |de )?[{_U}]{_L}+(?: (?:de |del |la )?[{_U}]{_L}+)*,?(?: n[º°o]\.?| núm\.?)? ?"
    rf"|(?P<german>(?:(?:Alte|Neue|Große|Kleine|Obere|Untere|Lange) )?(?:[{_U}]{_L}+-)*[{_U}]{_L}*?(?:{GERMAN})(?:(?<=\.)|(?!\w))|(?:Am|An der|Auf dem|Auf der|Im|In der|Zum|Zur|Unter den) [{_U}]{_L}+) ?)\Z"
)
_LETTER = re.compile(r" ?[a-z](?!\w)")
_WORD = re.compile(rf"{_L}+")
_INITIAL = re.compile(rf"[{_U}](?<![\w.'’@\-].)\.(?: ?[{_U}]\.)? {{1,2}}(?P<family>{_FAMILY})(?![\w@])")
_TITLED = re.compile(rf"(?<!\w)(?:Dr|Mr|Mrs|Ms|Prof|Frau|Herr|Mme|Madame|Monsieur|señora?|Señora?|Sra?)\.? (?P<name>(?P<given>[{_U}]{_L}+) (?:[{_U}]\. )?(?P<family>{_FAMILY}))(?![\w@])")
_ADDRESSED = re.compile(rf"(?P<name>(?P<given>[{_U}]{_L}+) (?:[{_U}]\. )?(?P<family>{_FAMILY}))\"? <[^<>\s]+@")

# Words before and after, in English, German, French and Spanish.
_CUES = {
    "phone": re.compile(r"(?:call|phone|tel|mob|mobile|fax|cell|number on|ring|reach|dial|text|whatsapp|ruf|unter|telefon|handy|rappelle|numéro|appel|joindre|llám|teléfono|móvil|\b[mt]\b)\W*(?:\w+\W+){0,4}$", re.I),
    "id_number": re.compile(r"(?:identity|passport|licen[cs]e|tax|social|security|insurance|id\b|ssn|nino|dni|nie|ausweis|steuer|nummer|passeport|pièce|identité|permis|identidad|identificación|documento|pasaporte)\W*(?:\w+\W+){0,5}$", re.I),
    "address": re.compile(r"(?:moving|move[ds]?|meet|at|to|parcel|lives?|living|address|zieh\w*|nach|paket|an|wohn\w*|habit\w*|colis|au|vivimos|vive|paquete|en|adresse|dirección)\W*(?:\w+\W+){0,2}$", re.I),
    "name": re.compile(r"(?:\b(?:dr|mr|mrs|ms|prof|miss|sir|frau|herr|mme|señora?|sra?)\b\.?|with|from|to|cc|by|met|asked|told|and|dear|hello|hi|liebe[rs]?|hallo|cher|chère|hola|estimad[oa]|von|an|mit|bei|und|de|à|avec|par|et|para|con|por|y|thanks|regards|sincerely|grüße|cordialement|saludos|[\"<>:,*\-])\s*$", re.I),
}
_STOP = r"[\"<,.:;!?)\]]|$|\n|\r"
_AFTER = {
    "phone": re.compile(rf"\s*(?:\(|{_STOP}|(?:ext|extension|durchwahl|poste|before|after|until|today|tonight|tomorrow|heute|morgen|ce soir|demain|hoy|mañana|or|oder|ou|o)\b)", re.I),
    "id_number": re.compile(rf"\s*(?:{_STOP}|(?:is|was|ist|war|est|était|es|era)\b)", re.I),
    "address": re.compile(rf"\s*(?:{_STOP}|(?:in|at|on|from|since|near|until|um|ab|seit|bis|depuis|dès|desde|hasta)\b)", re.I),
    "name": re.compile(rf"\s*(?:{_STOP}|(?:said|says|wrote|writes|called|calls|told|asked|asks|is|was|has|had|will|would|can|could|and|about|for|hat|ist|war|wird|sagt|sagte|fragt|schrieb|schreibt|und|nicht|a|est|était|dit|va|et|au|ha|es|era|dijo|dice|va|y|en|no|n'a|never)\b)", re.I),
}
_DECOY = re.compile(r"(?:invoice|order|ticket|batch|section|version|build|scored?|room|set|units?|meter|meter read|ref|article|isbn|sku|serial|page|chapter|lot|case|rechnung|bestell\w*|facture|commande|factura|pedido)\b[\s#:.\-]*(?:no\.? ?)?[\w\-]*$", re.I)
_FIRM = re.compile(r"\s*(?:&|Ltd|Limited|Inc|GmbH|AG|LLC|PLC|Corp|Corporation|Company|Co\b|Group|Trust|Bank|Partners|University|Hospital|School|Street|St\b|Road|Rd\b|Avenue|Lane|Drive|Close|Terrace|Crescent|Parade)")
_NO_FAMILY = set(
    """the a an and or but in on at to of for from with by as is was are were be been it its this that these those we you he she they i my our your his her their who what when where why how not no yes
    if so then than there here after before during since until while because although despite once again over under between back late last next today yesterday tomorrow monday tuesday wednesday thursday friday
    saturday sunday january february march april may june july august september october november december subject date sent tel fax mobile phone email regards thanks dear hi hello der die das ein eine und oder
    le la les un une et ou el los las y o ich wir sie er es je nous vous il elle yo""".split()
)


# Words that begin sentences, greetings and closings, and what stands in the names of firms, offices and jobs: no part of a person's name.
_NO_NAME = _NO_FAMILY | set(
    """above according across against almost along already among another any anybody anyone anything are around as ask because been both bring but can cannot check could did do does don each either else
    even ever every everyone everything few find first for further get give given good has have having her hers him how however if in indeed inside instead into just keep kindly last later least less let like likewise long
    look make many may maybe meanwhile might mine more most much must near neither never new none nor nothing now of off often ok old only other others ought our out outside per perhaps please put quite rather
    read really right said same say second see send several shall should show since some somebody someone something sometimes soon still such sure take tell thank that their them themselves third though through thus together
    too try two unless unlike until up upon us use usually various very via want well were whatever whenever whether which whoever whole will within without would yet yesterday your yours
    am an auf aus bei beim bis da dabei dafür damit danach dann daran darauf darum das dass dem den denn deren des deshalb dessen dich die dies diese diesem diesen dieser dieses dir doch dort du durch ein eine einem einen einer eines
    endlich erst etwas euch euer falls für gegen gestern hat hatte heute hier hin hinter im immer ihm ihn ihnen ihr ihre in ins ist ja jede jedem jeden jeder jedes jetzt kein keine kurz leider man mein meine meinem meinen meiner mich mir mit morgen
    nach neben nicht nichts noch nun nur ob oder ohne schon sehr sein seine seit sich sie sind so sobald solche sollte sollten sonst trotz über um und uns unser unsere unter viel viele vielen vom von vor wann war waren warum was weder wegen weil welche welcher wenn wer
    wie wieder wird wo wohl zu zum zur zwar zwischen liebe lieber liebes hallo guten bitte danke grüße gruß mfg
    au aux avec avant après alors aussi autre autres bien bonjour bonsoir car ce cela celle celui ces cet cette chaque chez cher chère comme comment dans de depuis des dès donc du elles en encore enfin entre est et eux ici ils jamais je jusque lorsque lui ma mais malgré
    même merci mes mon ne ni non nos notre on oui par parce parfois pas pendant peu peut plus pour pourquoi près puis quand que quel quelle quelques qui quoi sa salut sans selon ses si sinon son sous sur ta tandis tant te tes toi ton toujours tous tout toute toutes très trop tu vers vos votre
    al algo alguien algún alguna ante antes aquel aquella aquí aún aunque bajo bien buenos buenas cada casi como con contra cual cuando de del desde donde durante ella ellos en entonces entre era es esa ese eso esta estas este esto estos gracias hasta hola hoy jamás la las le les lo luego mañana más
    mi mientras mis mucho muy nada ni no nos nosotros nuestra nuestro nunca otra otro para pero poco por porque pues que querida querido quien se según ser si sí siempre sin sino sobre su sus tal también tan tanto te tras tu un una unos ustedes ya yo
    mon tue tues wed thu thur thurs fri sat sun jan feb mar apr jun jul aug sep sept oct nov dec januar februar märz mai juni juli oktober dezember montag dienstag mittwoch donnerstag freitag samstag sonntag
    janvier février mars avril juin juillet août septembre octobre novembre décembre lundi mardi mercredi jeudi vendredi samedi dimanche enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre lunes martes miércoles jueves viernes sábado domingo
    best kind warm many thanks yours sincerely faithfully cheers attention note notice confidential confidentiality disclaimer warning original forwarded message attachment attachments re fwd aw wg invoice order ticket version section page chapter figure table part room
    account accountant administration administrator advisor agency agent analyst architect assistant associate association author authority bank bay board bureau care centre center chair chairman chairwoman chief church city clerk clinic college commission committee community
    company conference consultant contact coordinator corporation council county customer data dean department deputy design desk developer development director district division doctor editor engineer engineering executive field finance
    foundation fund general group head health help hospital hotel house human inc information institute international island lab lake lead leader library limited llc ltd mail management manager marketing mayor meeting ministry museum national network news north nurse
    office officer online operations organisation organization park partner partners planning policy president press principal product professor program programme project public publishing records region regional relations report research resources river road
    sales school science secretary security senior service services shop society software solutions south specialist staff station street studio summary supervisor support system systems teacher team technical technology theatre trust union unit university update west east world""".split()
)
_COMMON_END = re.compile(r"(?:tion|ment|ness|ship|ität|keit|heit|schaft|ungen|mente)$", re.I)


def known_given(extra: list[str] = ()) -> set[str]:
    """Given names as they may be written: full ones in any case, short ones (of more than three letters) with a capital only, as many are words too."""
    full = set(NICKNAMES) | set(GIVEN) | set(extra)
    short = {s for shorts in NICKNAMES.values() for s in shorts.split() if len(s) > 3} - full
    return {form for n in full | {_plain(n) for n in full} for form in (n, n.title(), n.upper())} | {n.title() for n in short}


def _plain(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", name.replace("ø", "o").replace("ł", "l")) if not unicodedata.combining(c))


def _context(t: str, s: int, e: int, kind: str) -> tuple[int, int]:
    before, after = t[max(0, s - 45) : s], t[e : e + 20]
    line = before.rpartition("\n")[2]
    alone = (line.strip(" >\t*-") == "") and (after.lstrip(" \t")[:1] in ("", "\n", "\r"))
    if _DECOY.search(line) and kind in ("phone", "id_number"):
        b = -1
    else:
        b = 1 if alone or _CUES[kind].search(line) else 0
    if kind in ("phone", "id_number") and not alone and b >= 0:
        other = _CUES["id_number" if kind == "phone" else "phone"].search(line)
        if other and b == 0:
            b = -1
        elif other and not re.search(r"tel|mob|call|back on", line[-20:], re.I) and kind == "phone":
            b = -1 if re.search(r"gave|nummer|n[°º.]|no\.|demandé|passport|licen|identity", line[-24:], re.I) else 0
    return b, 1 if _AFTER[kind].match(after) or after == "" else 0


_CAPITAL = rf"[{_U}]{_L}*(?:['’\-]{_L}+)*"
#: Runs of capitalised words; a middle initial may stand between.
_OPEN = re.compile(rf"(?<![\w@.'’\-/&]){_CAPITAL}(?: {{1,2}}[{_U}]\.)?(?: {{1,2}}{_CAPITAL})+(?![\w@&]|[.'’\-][{_U}\w])")
_SENTENCE = re.compile(r"(?:^|[.!?…:]['\")\]»”]*\s+|[\n\r\t>*•\-–—|]\s*)\Z")
_SIGNED = re.compile(r"(?:,|^--)[ \t]*\r?\n(?:[ \t]*\r?\n)?[ \t>]*\Z", re.M)


def open_names(t: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, given, family, at a sentence's start) of runs of capitalised words that may be names, whatever the words.

    Function words, greetings and titles before a run are taken off; a run with
    such a word inside, in capitals throughout, or of more than three words
    besides an initial is none.
    """
    for m in _OPEN.finditer(t):
        run = m.group()
        if run.isupper():
            continue
        words = [w for w in re.finditer(r"\S+", run)]
        first = 0
        while first < len(words) and words[first].group().rstrip(".").lower() in _NO_NAME:
            first += 1
        words = words[first:]
        whole = [w.group() for w in words if not w.group().endswith(".")]
        if not 2 <= len(whole) <= 3 or any(len(w) < 2 or w.lower() in _NO_NAME or w.isupper() or _COMMON_END.search(w) for w in whole):
            continue
        s = m.start() + words[0].start()
        yield s, m.end(), whole[0], whole[-1], first == 0 and bool(_SENTENCE.search(t, max(0, s - 8), s))


def _places(t: str, words: set[str]) -> Iterator[tuple[int, int]]:
    """Where ``words`` stand in ``t`` as whole words."""
    for w in words:
        at = t.find(w)
        while at >= 0:
            end = at + len(w)
            if not t[at - 1 : at].isalpha() and not t[end : end + 1].isalpha():
                yield at, end
            at = t.find(w, end)


_JOINED = ("@", ".", "_", "-", "'", "’")


def candidates(t: str, given: set[str]) -> list[tuple]:
    """(kind, start, end, votes of format, gazetteer, before, after, shape, given, family) of one text's candidate spans."""
    out: list[tuple] = []
    taken: list[tuple[int, int]] = []

    def free(s: int, e: int) -> bool:
        return all(e <= a or s >= b for a, b in taken)

    words = set(_WORD.findall(t))
    bracketed = not words.isdisjoint(("at", "AT", "At")) and any(c in t for c in "[({")
    for anchor, check in ((_AT, "@" in t), (_BRACKETED, bracketed), (_SPOKEN, "dot" in words)):
        for m in anchor.finditer(t) if check else ():
            a = m.start()
            lo = a - 100
            while lo > 0 and not t[max(0, lo) : a].strip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"):
                lo -= 1000  # no white space yet: a longer local part
            left, right = _LOCAL.search(t[max(0, lo) : a]), _DOMAIN.match(t, m.end())
            if not left or not right:
                continue
            plain = m.group() == "@" and not left[1] and not right[1]
            if not plain and m.group() == "@" and not (left[1] and right[1]):
                continue
            s, e = a - len(left.group()), right.end()
            if free(s, e):
                taken.append((s, e))
                tld = re.split(r"\W+|dot", t[s:e].rstrip())[-1].lower()
                out.append(("email", s, e, 1 if plain else 0, 1 if len(tld) >= 2 else 0, 0, 1, 0 if plain else 1, "", ""))
    streets = not words.isdisjoint(_STREET_FORMS)
    numbers = False
    for m in _DIGITS.finditer(t):
        numbers = True
        s, e = m.span()
        following, last = t[e : e + 1], t[s - 2 : s] if s > 1 else ""
        found = None
        if following == " " or following == "," or following.isalpha():
            if e - s <= 5 and not t[s - 1 : s].isalnum() or s == 0:
                shape, f = 1, _ENGLISH.match(t, s) if streets else None
                if f and not _NO_STREET.isdisjoint(f.group().lower().split()[1:-1]):
                    f = None
                if not f:
                    shape, f = 2, _FRENCH.match(t, s)
                if f and "\n" not in f.group():
                    unit = _UNIT.search(t, max(0, s - 24), s) if shape == 1 else None
                    if unit or t[s - 1 : s] not in ("/", "#", ".", "-", ",") or s == 0:
                        found = (unit.start() if unit else s, f.end(), shape)
        if not found and e - s <= 6 and last[1:] in (" ", ".", "º", "°") and not last[:1].isdigit() and not last[:1].isspace():
            f = _TO_NUMBER.search(t, max(0, s - 70), s)
            if f and "\n" not in f.group() and not t[e : e + 1].isdigit():
                if f["box"]:
                    found = (f.start("s"), e, 0)
                elif e - s <= 5:
                    letter = _LETTER.match(t, e) if f["german"] else None
                    if letter or not following.isalpha():
                        found = (f.start("s"), letter.end() if letter else e, 4 if f["german"] else 3)
        if found and free(*found[:2]):
            s, e, shape = found
            taken.append((s, e))
            capital = shape == 0 or any(w[:1].isupper() for w in _WORD.findall(t[s:e]))
            out.append(("address", s, e, 1 if capital else 0, 1, *_context(t, s, e, "address"), shape, "", ""))
    if numbers:
        for run in _RUN.finditer(t):
            a, b = max(0, run.start() - 5), run.end() + 6
            here = []
            for kind, pattern in (("phone", _PHONE), ("id_number", _ID)):
                here += [(kind, m) for m in pattern.finditer(t, a, min(len(t), b)) if (m.end() < b or m.end() == len(t)) and free(*m.span())]
            for kind, m in here:
                s, e = m.span()
                if any(o.start() <= s and e <= o.end() and o.end() - o.start() > e - s for _, o in here):
                    continue  # part of a longer number
                text, weak = m.group(), m.lastgroup == "weak"
                known = 1 if (text[0] in "+(0" and not (weak and len(text) == 11) if kind == "phone" else not text.isdigit()) else 0
                out.append((kind, s, e, 0 if weak else 1, known, *_context(t, s, e, kind), 1 if weak else 0, "", ""))
        for m in _LICENCE.finditer(t):
            if free(*m.span()) and _ID.match(t, m.start()):
                out.append(("id_number", *m.span(), 1, 1, *_context(t, *m.span(), "id_number"), 2, "", ""))
    taken += [(x[1], x[2]) for x in out if x[0] in ("phone", "id_number")]
    seen: set[tuple[int, int]] = set()

    def name(s: int, e: int, g: str, f: str, form: int, gaz: int, shape: int) -> None:
        if not free(s, e) or any(s < b and a < e for a, b in seen):
            return
        seen.add((s, e))
        after_text = t[e : e + 24]
        before, after = _context(t, s, e, "name")
        if _FIRM.match(after_text):
            after = -1
        low_f = f.lower()
        if low_f in _NO_FAMILY:
            form = -1
        out.append(("name", s, e, form, gaz, before, after, shape, g.lower(), low_f))

    for s, e in sorted(_places(t, given & words)):
        g = t[s:e]
        if t[s - 1 : s] in _JOINED and s > 0 or t[e : e + 1] in ("@", "_", "-"):
            continue
        style = 1 if g.islower() else 2 if g.isupper() else 0
        f = _AHEAD[style].match(t, e)
        if f and f["family"].lower() not in _NO_FAMILY:
            name(s, f.end(), g, f["family"], 1 if style != 1 else 0, 1, style)
            continue
        b = _BEHIND[style].search(t, max(0, s - 70), s)
        if b and b["family"] not in given and b["family"].lower() not in _NO_FAMILY:
            name(b.start("family"), e, g, b["family"], 1, 1, 3)
    if ". " in t:
        for m in _INITIAL.finditer(t):
            name(*m.span(), m.group()[0] + ".", m["family"], 0, 0, 4)
    for pattern, check in ((_TITLED, not words.isdisjoint(_TITLES)), (_ADDRESSED, " <" in t)):
        for m in pattern.finditer(t) if check else ():
            name(*m.span("name"), m["given"], m["family"], 1, 0, 5)
    for s, e, g, f, at_start in open_names(t):
        if not (free(s, e) and not any(s < b and a < e for a, b in seen)) or _FIRM.match(t, e):
            continue
        line_start = max(t.rfind("\n", 0, s), t.rfind("\r", 0, s)) + 1
        before, after = _context(t, s, e, "name")
        if not t[line_start:s].strip(" >\t*-"):  # at the head of a line: only what stands above it can tell a signature
            before = 1 if _SIGNED.search(t, max(0, s - 60), s) else 0
        seen.add((s, e))
        out.append(("name", s, e, 0 if at_start else 1, 0, before, after, 7 if at_start else 6, g.lower(), f.lower()))
    return out


_STREET_FORMS = {form for w in STREETS for form in (w, w.title(), w.upper())}
_NO_STREET = _NO_FAMILY - {"st"}
_TITLES = {"Dr", "Mr", "Mrs", "Ms", "Prof", "Frau", "Herr", "Mme", "Madame", "Monsieur", "señor", "señora", "Señor", "Señora", "Sr", "Sra"}
_AHEAD = (
    re.compile(rf" {{1,2}}(?:[{_U}]\. ?)?(?P<family>{_FAMILY})(?![\w@_])"),
    re.compile(rf" {{1,2}}(?:[a-z]\. ?)?(?P<family>[a-zß-öø-ÿł]{{4,}}(?:-[a-zß-öø-ÿł]{{3,}})?)(?![\w@_])"),
    re.compile(rf" {{1,2}}(?:[{_U}]\. ?)?(?P<family>[{_U}]{{2,}}(?:-[{_U}]{{2,}})?)(?![\w@_])"),
)
_BEHIND = (
    re.compile(rf"(?<![\w@.])(?P<family>{_FAMILY}), ?\Z"),
    re.compile(r"(?<![\w@.])(?P<family>[a-zß-öø-ÿł]{4,}(?:-[a-zß-öø-ÿł]{3,})?), ?\Z"),
    re.compile(rf"(?<![\w@.])(?P<family>[{_U}]{{2,}}(?:-[{_U}]{{2,}})?), ?\Z"),
)

_SPAN = "kind string, start int, end int, found string, format byte, gazetteer byte, before byte, after byte, shape byte, given string, family string"


def find_candidates(texts: DataFrame, given: list[str] = ()) -> DataFrame:
    """(src, row_id, kind, start, end, found, votes…) of all candidate spans of (src, row_id, text); whole texts, null ones have none."""
    names = known_given(given)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owner = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for c in candidates(text, names):
                    owner.append(i)
                    rows.append((c[0], c[1], c[2], text[c[1] : c[2]], *c[3:]))
                if len(rows) >= 20_000:
                    yield pack(batch, owner, rows)
                    rows, owner = [], []
            if rows:
                yield pack(batch, owner, rows)

    def pack(batch: pa.RecordBatch, owner: list[int], rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int32(), pa.int32(), pa.string(), *[pa.int8()] * 5, pa.string(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        at = pa.array(owner, pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=["src", "row_id", *[c.split()[0] for c in _SPAN.split(", ")]])

    return texts.where(F.col("text").isNotNull()).select("src", "row_id", "text").mapInArrow(scan, f"src string, row_id bigint, {_SPAN}")


def learn_given(headers: DataFrame, text: str = "text", families: int = 3) -> DataFrame:
    """(given): words that head addresses beside at least ``families`` different family names, however rare they are; a table, not a list."""
    found = F.regexp_extract_all(F.col(text), F.lit(rf'(?m)^>*\s*\*?(?:From|To|Cc|Von|An|De|À|Para)\s?:\*? "?([\p{{Lu}}]\p{{L}}+ \p{{Lu}}[\p{{L}}\-]+)"? <[^<>@\s]+@'), F.lit(1))
    pairs = headers.where(F.col(text).contains("@")).select(F.explode(found).alias("n")).select(F.lower(F.split("n", " ")[0]).alias("given"), F.lower(F.split("n", " ")[1]).alias("family"))
    counts = pairs.groupBy("given").agg(F.approx_count_distinct("family").alias("families"))
    return counts.where(F.col("families") >= families).select("given")


def expectation_maximisation(votes: np.ndarray, n: np.ndarray, group: np.ndarray | None = None, hope: np.ndarray | None = None, rounds: int = 100, strength: float = 25.0) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the vote patterns (rows of -1, 0, 1; n occurrences each) and the labelers' tables P(vote | truth).

    ``group`` numbers the ways in which spans are proposed, and ``hope`` says
    what share of each is expected to be right; the shares are estimated too.
    Starts from, and is drawn to, moderately reliable labelers; ``strength``
    is the weight of that prior in spans, so that it matters on small data only.
    """
    prior = np.array([[0.75, 0.0, 0.25], [0.12, 0.0, 0.88]]) * strength  # [truth][vote -1, 0, 1]
    table = np.repeat((prior / prior.sum(axis=1, keepdims=True))[None], votes.shape[1], axis=0)
    group = np.zeros(len(votes), dtype=int) if group is None else group
    hope = np.full(int(group.max(initial=0)) + 1, 0.6) if hope is None else hope
    share = hope.copy()
    for _ in range(rounds):
        like = np.c_[1 - share[group], share[group]]
        for k in range(votes.shape[1]):
            like = like * np.where((votes[:, k] == 0)[:, None], 1.0, table[k][:, votes[:, k] + 1].T)  # who abstains says nothing
        post = like[:, 1] / like.sum(axis=1)
        share = (np.bincount(group, n * post, len(hope)) + 10 * hope) / (np.bincount(group, n, len(hope)) + 10)
        for k in range(votes.shape[1]):
            for z, w in ((0, 1 - post), (1, post)):
                table[k][z] = prior[z] + np.bincount(votes[:, k] + 1, n * w * (votes[:, k] != 0), 3)
            table[k] /= table[k].sum(axis=1, keepdims=True)
    return post, table


def train_classifier(features: np.ndarray, target: np.ndarray, n: np.ndarray, steps: int = 400, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic model on soft targets, by gradient descent with the step of the curvature's bound."""
    x = np.c_[np.ones(len(features)), features]
    weight = np.sqrt(n) / np.sqrt(n).sum()  # frequent patterns count more, rare ones are not drowned
    w, rate = np.zeros(x.shape[1]), 4.0 / x.shape[1] * 2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * (x.T @ (weight * (p - target)) + ridge * w)
    return w


def _features(patterns: pd.DataFrame) -> np.ndarray:
    columns = [(patterns[c].to_numpy()[:, None] == np.array([-1, 1])).astype(float) for c in LABELERS]
    return np.hstack([*columns, (patterns["shape"].to_numpy()[:, None] == np.arange(SHAPES)).astype(float)])


def decide(patterns: pd.DataFrame) -> pd.DataFrame:
    """``patterns`` (kind, votes, shape, n) with the columns posterior and p, by a model of each kind."""
    parts = []
    for _, of_kind in patterns.groupby("kind"):
        of_kind = of_kind.reset_index(drop=True)
        votes = of_kind[list(LABELERS)].to_numpy().astype(int)
        n = of_kind["n"].to_numpy().astype(float)
        shape = of_kind["shape"].to_numpy().astype(int)
        posterior, _ = expectation_maximisation(votes, n, shape, np.array(HOPES.get(of_kind["kind"][0], [0.6] * SHAPES)))
        x = _features(of_kind)
        w = train_classifier(x, posterior, n)
        parts.append(of_kind.assign(posterior=posterior, p=1 / (1 + np.exp(-(np.c_[np.ones(len(x)), x] @ w)))))
    return pd.concat(parts) if parts else patterns.assign(posterior=0.0, p=0.0)


def with_company(found: DataFrame, learned: DataFrame | None) -> DataFrame:
    """Candidates with the column company, and given names that address headers teach in gazetteer.

    company is 1 for a name whose family name stands beside another, listed or
    learned, given name somewhere in the texts, else 0: more data can speak for
    a name, never against it. Only names are joined; the others have no family.
    """
    names, others = found.where("kind = 'name'"), found.where("kind <> 'name'")
    if learned is not None:
        names = names.join(learned.select("given", F.lit(True).alias("_known")).distinct(), "given", "left")
        names = names.withColumn("gazetteer", F.when((F.col("gazetteer") == 0) & F.col("_known"), 1).otherwise(F.col("gazetteer")).cast("byte")).drop("_known")
    pairs = names.where("gazetteer = 1").select("family", "given").distinct()
    families = pairs.groupBy("family").agg(F.min("given").alias("_one"), F.max("given").alias("_other"))
    other = F.col("_one").isNotNull() & ((F.col("_one") != F.col("given")) | (F.col("_other") != F.col("given")))
    names = names.join(families, "family", "left").withColumn("company", F.when(other, 1).otherwise(0).cast("byte")).drop("_one", "_other")
    return names.unionByName(others.withColumn("company", F.lit(0).cast("byte")))


def find_personal(texts: DataFrame, given: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(src, row_id, pii_type, pii_text, start, end, p): the personal spans of texts (src, row_id, text).

    Types are email, phone, id_number, address and name; start and end count
    code points. Of spans that overlap, the likelier, then the longer one
    holds. ``given`` is a table of learned given names. Placeholders, firms' names, and numbers of invoices, orders,
    versions and the like do not count. Null and empty texts have none;
    repeated rows give repeated spans once.
    """
    spark = texts.sparkSession
    found = with_company(durable(find_candidates(texts).distinct(), "p1-candidates"), given)
    key = ["kind", *LABELERS, "shape"]
    patterns = found.groupBy(*key).agg(F.count("*").alias("n")).toPandas()  # at most 5 kinds x 3**5 votes x 8 shapes
    scored = decide(patterns)
    model = spark.createDataFrame(scored[[*key, "p"]].astype(dict.fromkeys([*LABELERS, "shape"], int)), ", ".join(["kind string", *[f"{c} int" for c in [*LABELERS, "shape"]], "p double"])) if len(scored) else None
    if model is None:
        return found.select("src", "row_id", F.col("kind").alias("pii_type"), F.col("found").alias("pii_text"), "start", "end", F.lit(0.0).alias("p"))
    kept = found.join(F.broadcast(model), key).where(F.col("p") >= threshold)
    # one place read as two types: the words before it decide, then the probability
    same = kept.groupBy("src", "row_id", "start", "end").agg(F.max(F.struct("before", "p", "kind", "found")).alias("b"))
    return same.select("src", "row_id", F.col("b.kind").alias("pii_type"), F.col("b.found").alias("pii_text"), "start", "end", F.col("b.p").alias("p"))


def redact(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(src, row_id, text): each span replaced by a placeholder of its type, such as [EMAIL]; all else stays as it was."""
    of_row = spans.groupBy("src", "row_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", F.upper("pii_type").alias("type")))).alias("spans"))
    joined = texts.join(of_row, ["src", "row_id"], "left")
    # each step appends the text up to the span and its placeholder; overlapping ones are skipped
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["type"], F.lit("]")).alias("done"), s["end"].alias("at")),
    ).otherwise(acc)
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    empty = F.array().cast("array<struct<start:int,end:int,type:string>>")
    built = F.aggregate(F.coalesce("spans", empty), start, step, lambda acc: F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return joined.select("src", "row_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(built).alias("text"))
