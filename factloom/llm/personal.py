"""Personal information in free text: found by anchors, bounded by local parsers, replaced by typed placeholders.

One Aho-Corasick automaton finds anchors in the lower-cased text: at-signs and their disguises, schemes, labels of
identity numbers, words for streets, titles, common given names, words for what one person is to another, sign-offs and
phrases that introduce a person. Runs of digits are the anchors of numbers; identity numbers with a check digit count
without a label. At each anchor a deterministic parser expands to both sides and accepts or rejects. Names are also taken from cells of contact records, beside a cell with other personal information.

Types: ``email`` the whole mailbox, disguised ones too; ``phone`` from the leading plus, bracket or first digit to the
last digit; ``id_number`` without label; ``address`` street and house number with flat, floor or rear building;
``name`` as written, without title. Where findings overlap the order is email, id_number, phone, address, name.

Defined cases: null, empty and blank texts hold nothing and stay as they are; a text is read whole; findings of a row
are distinct, repeated rows are found each; offsets count characters of the original text.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

Span = tuple[int, int, str]

# ---- fixed values -------------------------------------------------------------------------------------------------

AT_SIGNS = ["@", "＠", "(at)", "[at]", "{at}", " at ", "&#64;"]
#: top-level names accepted where the dots are spelled out, as ordinary words may follow
SPELLED_TOPS = set(
    "com org net edu gov mil int info biz name pro app dev io co me tv ai eu uk us de fr es it nl be ch at pl pt se no dk fi cz ru ua cn jp kr in br mx ar cl ca au nz ie za tr gr example invalid test localhost".split()
)
#: words that stand before an ordinary "at"
NO_MAILBOX = set("look looks looked looking is are was were be stay meet live lives arrive sit work works good bad market opens start starts end".split())

ID_LABELS = [
    "ssn", "social security number", "social security no", "social security", "national insurance number", "national insurance no", "national insurance", "ni number",
    "passport number", "passport no", "passport", "id card number", "id card", "identity card", "identity number", "id number", "id no", "tax id", "tax number", "tin", "id",
    "steuernummer", "steuer-id", "steueridentifikationsnummer", "ausweisnummer", "personalausweis", "sozialversicherungsnummer", "reisepass", "reisepassnummer", "passnummer",
    "dni", "nie", "nif", "pasaporte", "número de pasaporte", "seguridad social", "documento de identidad", "número de identidad", "número de identificación",
    "passeport", "sécurité sociale", "numéro fiscal", "carte d'identité", "nir", "numéro d'identité",
    "инн", "снилс", "паспорт", "номер паспорта", "удостоверение личности",
    "身份证号", "身份证", "护照号", "护照", "社保号", "税号",
]
PHONE_LABELS = [
    "tel", "tel.", "tél", "tél.", "phone", "fax/phone", "mobile", "cell", "call", "text me on", "number is", "telefon", "rufen sie", "mobil", "handy", "teléfono", "llame al", "móvil", "téléphone",
    "appelez le", "тел", "тел.", "телефон", "звоните", "电话", "请拨打", "手机", "m",
]
#: labels of numbers that belong to no person
OTHER_LABELS = [
    "ticket", "order no.", "order no", "order", "isbn", "version", "total", "tariff line", "part", "flight", "checksum", "grid", "invoice", "invoice no.", "item", "ref", "ref.", "seen at", "case no.", "serial", "article", "artículo", "posten", "позиция", "项目", "rechnung", "factura", "facture", "commande", "pedido", "bestellung", "заказ", "订单", "订单号",
]

STREET_EN = ["street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "close", "terrace", "boulevard", "blvd", "drive", "dr", "court", "ct", "square", "sq", "place", "pl", "way", "crescent", "row", "walk", "gardens", "hill", "mews", "parade", "quay", "grove", "highway", "hwy", "parkway", "pkwy", "alley"]
#: types that are written with a dot
SHORTENED = {"st", "ave", "ln", "blvd", "dr", "ct", "sq", "pl", "hwy", "pkwy"}
STREET_FR = ["rue", "avenue", "av.", "place", "bd", "boulevard", "quai", "allée", "chemin", "impasse", "route", "cours", "square", "passage"]
STREET_ES = ["calle", "c/", "plaza", "pza.", "avda.", "avda", "avenida", "av.", "paseo", "pº", "camino", "carretera", "ronda", "travesía"]
STREET_IT = ["via", "viale", "corso", "piazza", "rua", "largo", "travessa", "vicolo"]
STREET_DE = ["straße", "strasse", "str.", "weg", "allee", "platz", "gasse", "ring", "damm", "ufer", "steig", "chaussee"]
STREET_RU = ["ул.", "улица", "пр-т", "проспект", "пр.", "пер.", "переулок", "площадь", "пл.", "бульвар", "б-р", "шоссе", "набережная", "наб.", "проезд"]

#: common given names of several languages, anchors of names that no other word introduces
GIVEN = set(
    """james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony paul steven andrew george edward brian kevin peter simon martin
    mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa margaret sandra emily laura anna emma olivia sophia julia alice helen claire jane kate rachel hannah
    hans klaus jürgen wolfgang stefan andreas heinz karl lukas felix jonas sabine ursula petra monika heike katrin ingrid greta lena
    jean pierre michel philippe jacques françois louis antoine luc marie nathalie isabelle catherine sophie camille élodie chloé émile
    josé juan carlos luis miguel francisco antonio pedro manuel jorge diego pablo maría maria carmen ana lucía sofía rosa elena isabel
    giovanni marco matteo luca giuseppe giulia chiara francesca joão paulo pavel tomasz piotr jan lars sven erik astrid ivan dmitri sergei olga natalia irina
    mohammed ahmed ali fatima omar hassan ibrahim yusuf aisha mehmet priya raj amit wei ming yuki hiroshi kwame
    grace rose sophie svetlana tatiana nina laila samuel benjamin henry oliver jack lucy amelia иван дмитрий сергей алексей андрей александр михаил николай владимир олег павел юрий анна мария ольга наталья ирина елена светлана татьяна марина""".split()
)
#: words for what one person is to another, after which or before which a name stands
ROLES = set(
    """landlord landlady tenant lodger owner neighbour neighbor wife husband partner son daughter brother sister mother father uncle aunt cousin friend colleague boss manager supervisor doctor dentist nurse lawyer solicitor teacher
    agent assistant secretary client customer patient caretaker plumber driver applicant witness guest
    mieter mieterin vermieter vermieterin nachbar nachbarin kollege kollegin chef chefin arzt ärztin freund freundin
    locataire propriétaire voisin voisine mari collègue médecin inquilino inquilina dueño dueña vecino vecina marido esposa jefe jefa médico
    жилец жилица сосед соседка жена муж коллега врач""".split()
)
#: words a person is the object of
VERBS = set("ask asked call called meet met contact tell told thank thanked invite invited visit visited married hired know knew remember phone phoned with".split())
SIGN_OFFS = ["best,", "best wishes,", "kind regards,", "best regards,", "warm regards,", "regards,", "thanks,", "many thanks,", "cheers,", "sincerely,", "yours sincerely,", "yours,", "love,", "grüßen,", "grüße,", "gruß,", "atentamente,", "saludos,", "cordialement,", "salutations,", "bien à vous,", "с уважением,", "此致，"]
#: labels and phrases right before a name
LABELS = [
    "signed by ", "contact: ", "contact person: ", "attn: ", "attn. ", "name: ", "my name is ", "i am ", "i'm ", "ansprechpartner: ", "kontakt: ", "mein name ist ", "ich heiße ", "contacto: ", "firmado por ", "me llamo ",
    "contact : ", "signé par ", "je m'appelle ", "контакт: ", "контактное лицо: ", "подписал ", "подписала ", "меня зовут ", "联系人：", "联系人: ", "签名：", "我叫",
]
_DID = r"\s+(?:\p{Ll}{3,}ed|came|wrote|left|went|said|told|brought|paid|rang|spoke)\b"
#: (word that opens a report about somebody, what stands between it and the name, what has to follow the name)
REPORTS: list[tuple[str, str, str]] = [
    *((w, r",?\s+", _DID) for w in ("yesterday", "today", "tonight", "this morning", "last night", "last week")),
    *((w, r"\s+(?:kam|rief|war|schrieb|ging|fuhr)\s+", r"\s+(?:vorbei|an|zurück|hier|da|weg|uns|mich|zweimal|noch|um|mit)\b") for w in ("gestern", "heute", "vorgestern")),
    *((w, r"\s+(?:\p{Ll}+ó|vino|estuvo|dijo)\s+", r"\s+(?:dos|tres|otra|varias|al|a|por|para|en|con)\b") for w in ("ayer", "anoche", "hoy")),
    *((w, r",?\s+", r"\s+(?:est|a|était|avait|nous)\b") for w in ("hier", "ce matin", "aujourd'hui")),
    *((w, r"\s+\p{Ll}+л[аи]?\s+", r"") for w in ("вчера", "сегодня", "утром")),
    *((w, r"\s*", r"\s*(?:来|打|说|去了|到|走|给|在|把)") for w in ("昨天", "今天", "前天", "刚才")),
]
#: fixed values: common Chinese surnames
SURNAMES_ZH = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段钱汤尹黎易常武乔贺赖龚文"
PLACES = set("san santa são saint sankt st mount lake port fort new rue calle via plaza piazza avenida avenue camp cape sierra villa los las el la le ciudad boulevard".split())
TITLES = ["dr. ", "dr ", "mr. ", "mr ", "mrs. ", "mrs ", "ms. ", "ms ", "mister ", "sig. ", "sig.ra ", "dott. ", "miss ", "prof. ", "sir ", "herr ", "herrn ", "frau ", "sr. ", "sra. ", "srta. ", "don ", "doña ", "señor ", "señora ", "señorita ", "senhor ", "senhora ", "mme ", "mlle ", "monsieur ", "madame ", "г-н ", "г-жа ", "господин ", "госпожа "]

ORGANISATION = set(
    "institute press council railways works cooperative observatory museum university college company corporation corp inc ltd llc gmbh ag sa bank group society association foundation agency office committee department ministry school church hospital club union library theatre theater market hotel airlines authority board bureau centre center laboratory labs services systems team street road avenue lane close terrace square bridge station harbor harbour".split()
)
#: words that begin sentences or belong to place names, so no given names
NO_GIVEN = set(
    """the a an and or but if when while was were is are be been it its this that these those he she they we you i in on at by for from with without according between before after during almost nobody once every last
    early item order part ticket version total seen flight grid tariff dear ping call write mail deliver address her his my our your national social passport article which who why what where how there here now then
    das die der den dem ein eine wenn war waren laut zwischen niemand noch einmal vor nach während ohne fast jeden posten im am bei auf sie er es und aber bitte rückfragen telefon
    el la los las un una si era según entre nadie una vez antes tras durante casi cada sin artículo en escriba correo dirección vive número llame pero y
    le les l' une si selon entre personne avant après pendant presque chaque sans au en écrivez courriel adresse il elle appelez numéro mais et
    по если неужели с между никто до после во время почти каждый без позиция план ещё раз адрес почта живёт номер
    yesterday contact regards signed tenant sincerely gestern ayer atentamente cordialement contacto kontakt вчера уважением questions reach write call text signed social miss mrs mr dr frau herr sra mme
    lake fort port new old upper lower saint mount north south east west grand monsieur street road flat apt""".split()
)
PARTICLES = r"(?:van der|van den|van de|van|von der|von|de la|de los|del|della|de|der|den|di|da|dos|du|la|le|al|el|bin|ben|ter|ten|zu|af)"

# ---- anchors ------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    kinds: dict[str, list[tuple[str, object]]] = {}

    def add(word: str, kind: str, more: str = "") -> None:
        kinds.setdefault(word.lower(), []).append((kind, more))

    for w in AT_SIGNS:
        add(w, "at")
    for w in ID_LABELS:
        add(w, "id")
    for w in STREET_EN:
        add(" " + w, "en")
    for w in STREET_FR:
        add(" " + w + " ", "fr")
    for w in STREET_ES:
        add(w + " ", "es")
    for w in STREET_IT:
        add(w + " ", "it")
    for w in STREET_DE:
        add(w + " ", "de")
    for w in STREET_RU:
        add(w, "ru")
    for w in LABELS:
        add(w, "name")
    for w in SIGN_OFFS:
        add(w, "sign")
    for w, lead, after in REPORTS:
        kinds.setdefault(w, []).append(("report", (lead, after)))
    for w in TITLES:
        add(w, "title")
    for w in GIVEN:
        add(w, "given")
    for w in ROLES:
        add(w, "role")
    for w in VERBS:
        add(w + " ", "verb")
    for word, found in kinds.items():
        auto.add_word(word, (len(word), found))
    auto.make_automaton()
    return auto


def lowered(text: str) -> str:
    """Lower case with the same offsets."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


# ---- mail ---------------------------------------------------------------------------------------------------------

_LATIN = r"\p{Latin}\p{M}\p{Greek}\p{Cyrillic}0-9"
_LOCAL = regex.compile(rf"(?:[{_LATIN}._%+\-]|(?<=\p{{L}})['’](?=\p{{L}}))*[{_LATIN}_+]$")
_DOT = r"(?:\.|\s*\[dot\]\s*|\s*\(dot\)\s*|\s*\{dot\}\s*|\s+dot\s+)"
#: parts of a local part before a spelled dot; a bare "dot" only counts where the at-sign is spelled, too
_LOCAL_DOTS = regex.compile(rf"[{_LATIN}._%+\-]*[{_LATIN}_](?:\s*(?:\[dot\]|\(dot\)|\{{dot\}})\s*[{_LATIN}_\-]+|\s+dot\s+[{_LATIN}_\-]+)+$", regex.I)
_DOMAIN = regex.compile(rf"[{_LATIN}](?:[{_LATIN}\-]*[{_LATIN}])?(?:{_DOT}[{_LATIN}](?:[{_LATIN}\-]*[{_LATIN}])?)*", regex.I)
_SPELLED = regex.compile(r"\s+dot(?:\s|$)", regex.I)
_PIECE_DOT = regex.compile(_DOT, regex.I)


def _mail(text: str, start: int, end: int, sign: str) -> Span | None:
    left = start
    wordy = sign == " at "
    if not wordy:
        while left and text[left - 1] in " \t" and start - left < 2:
            left -= 1
    m = sign not in ("@", "＠") and _LOCAL_DOTS.search(text, max(0, left - 80), left) or _LOCAL.search(text, max(0, left - 80), left)
    if not m or not (local := m[0].lstrip(".%-'’")):
        return None
    begin = left - len(local)
    right = end
    while right < len(text) and text[right] in " \t" and right - end < 2:
        right += 1
    d = _DOMAIN.match(text, right)
    if not d:
        return None
    # longest run of labels that ends in a name of letters
    cuts = [(x.start(), x.group()) for x in _PIECE_DOT.finditer(text, d.start(), d.end())]
    stops = [*[c for c, _ in cuts], d.end()]
    for k in range(len(stops) - 1, 0, -1):
        stop = stops[k]
        at, dot = cuts[k - 1]
        top = text[at + len(dot) : stop]
        spelled = any(x.strip().lower() == "dot" for _, x in cuts[:k])
        if not top.isalpha() or len(top) < 2:
            continue
        if spelled and (top.lower() not in SPELLED_TOPS or _SPELLED.match(text, stop)):
            continue
        if wordy and (not spelled or local.lower() in NO_MAILBOX):
            return None
        return begin, stop, "email"
    return None


# ---- identity numbers ---------------------------------------------------------------------------------------------

_ID_GAP = regex.compile(r"(?:\s*(?:card|number|no\.?|nr\.?|n°|nº|№|num\.?|is|ist|es|est|:|：|#|=|-|–))*\s*", regex.I)
_ID_VALUE = regex.compile(
    r"(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]{1,3}-?\d{4}-?\d{3,5}|[A-Z]{1,2}\d{6,9}[A-Z]?|\d{2}[A-Z]{2}\d{5}|\d{4} \d{6}|\d{8}-?[A-Z]|\d{3}[- ]\d{2}[- ]\d{4}|\d{2} \d{3} \d{3} \d{3}"
    r"|\d{2} \d{2} \d{6}|\d{3}-\d{3}-\d{3} \d{2}|[A-Z]\d{7,8}|\d \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?|\d{17}[\dX]|\d{6,15})(?![\w]|-\d)",
    regex.I,
)


def _identity(text: str, low: str, start: int, end: int) -> Span | None:
    if start and (low[start - 1].isalnum() and low[start].isascii()):
        return None
    if end < len(text) and low[end].isalpha() and low[end - 1].isalpha() and low[start].isascii():
        return None
    gap = _ID_GAP.match(text, end)
    m = _ID_VALUE.match(text, gap.end())
    if not m or (gap.end() == end and low[end - 1].isascii()):
        return None
    return m.start(), m.end(), "id_number"


def _dni(v: str) -> bool:
    digits = v.replace("-", "").translate(str.maketrans("XYZ", "012"))
    return digits[-1] == "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits[:-1]) % 23]


def _cpf(v: str) -> bool:
    d = [int(c) for c in v if c.isdigit()]
    return len(set(d)) > 1 and all(sum(d[k] * (n + 1 - k) for k in range(n)) * 10 % 11 % 10 == d[n] for n in (9, 10))


def _cn(v: str) -> bool:
    weights = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
    return "10X98765432"[sum(int(c) * w for c, w in zip(v, weights)) % 11] == v[-1].upper()


def _nir(v: str) -> bool:
    d = v.replace(" ", "")
    return 97 - int(d[:13]) % 97 == int(d[13:])


#: numbers whose form and check digit say what they are, wherever they stand
_CHECKED: list[tuple[regex.Pattern, Callable[[str], bool]]] = [
    (regex.compile(r"(?<![\w.\-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w\-])"), lambda v: True),
    (regex.compile(r"(?<![\w.\-])\d{3}\.\d{3}\.\d{3}-\d{2}(?![\w\-])"), _cpf),
    (regex.compile(r"(?<![\w.\-])(?:\d{8}|[XYZ]-?\d{7})-?[A-Z](?![\w\-])"), _dni),
    (regex.compile(r"(?<![\w.\-])[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?![\w\-])"), _cn),
    (regex.compile(r"(?<![\w.\-])[12] \d{2} (?:0[1-9]|1[0-2]) \d{2} \d{3} \d{3} \d{2}(?![\w\-])"), _nir),
]


def _checked(text: str) -> Iterator[Span]:
    for pattern, right in _CHECKED:
        for m in pattern.finditer(text):
            if right(m[0]) and not _OTHER_LABEL.search(text[max(0, m.start() - 24) : m.start()]):
                yield m.start(), m.end(), "id_number"


# ---- phones -------------------------------------------------------------------------------------------------------

_NUMBERS = regex.compile(r"(?<![\w.,])(?:\+\s?|\(\+?)?\d(?:(?:[\d\u00a0\-–()]|\.(?! )| (?![/ ])|/(?! ))*\d)?(?![\w])")
_SEP = r"(?:[ \u00a0.\-–/]| [–-] )"
_PHONES = [
    regex.compile(rf"\+\d{{1,3}}(?:{_SEP}?\(0\))?(?:(?:{_SEP}?\(\d+\)|{_SEP}?\d+)){{1,6}}"),
    regex.compile(rf"\(\+\d{{1,3}}\)(?:{_SEP}?\d+){{1,6}}"),
    regex.compile(rf"00[1-9]\d{{0,2}}(?:{_SEP}\d+){{1,5}}"),
    regex.compile(rf"\(\d{{2,5}}\){_SEP}?\d{{3,8}}(?:{_SEP}\d{{2,5}})?"),
    regex.compile(r"(?:1[ .\-–] ?)?\d{3}(?P<s>[.\-]| – | - )\d{3}(?P=s)\d{4}"),
    regex.compile(r"1 \d{3} \d{3} \d{4}"),
    regex.compile(r"0\d(?P<s>[ \u00a0.\-])\d\d(?P=s)\d\d(?P=s)\d\d(?P=s)\d\d"),
    regex.compile(r"0[1-9]\d{1,4}[ \u00a0/\-]\d{4,8}(?:[ \u00a0\-]\d{2,5})?"),
    regex.compile(r"0[1-9]\d \d{4} \d{4}"),
    regex.compile(r"\d{3}\u00a0\d{3}\u00a0\d{3,4}"),
]
_ANY_PHONE = regex.compile(rf"\d(?:{_SEP}?\(?\d\)?){{6,13}}")
_NOT_PHONE = regex.compile(r"\d{3}[- ]\d{2}[- ]\d{4}|\d{2} \d{3} \d{3} \d{3}|\d{2} \d{2} \d{6}|\d{4}-\d{2}-\d{2}.*|(?:1[89]|20)\d\d[-–](?:1[89]|20)\d\d|97[89][- ].*|\d{4}\.\d{2}\.\d{2}|\d\.\d{6,}")
_PHONE_LABEL = regex.compile(r"(?:^|[^\p{L}])(?:" + "|".join(map(regex.escape, sorted(PHONE_LABELS, key=len, reverse=True))) + r")\.?\s*[:：]?\s*$", regex.I)
_OTHER_LABEL = regex.compile(r"(?:^|[^\p{L}])(?:" + "|".join(map(regex.escape, sorted(OTHER_LABELS, key=len, reverse=True))) + r")\.?\s*[:：#]?\s*$", regex.I)


def _phone(text: str, m: regex.Match) -> Span | None:
    """The number in a run of digits and separators: the longest prefix of groups that is a phone number."""
    start, end = m.span()
    before = text[max(0, start - 24) : start]
    if _OTHER_LABEL.search(before):
        return None
    labelled = bool(_PHONE_LABEL.search(before))
    best = 0
    for p in _PHONES:
        if (x := p.match(text, start)) and x.end() <= end and 8 <= sum(c.isdigit() for c in x[0]) <= 15 and not (x.end() < len(text) and text[x.end()].isalnum()):
            best = max(best, x.end())
    if not best and labelled and (x := _ANY_PHONE.match(text, start)) and x.end() <= end:
        best = x.end()
    if not best or _NOT_PHONE.fullmatch(text, start, best):
        return None
    return start, best, "phone"


# ---- addresses ----------------------------------------------------------------------------------------------------

_WORD = r"[\p{Lu}][\p{L}'’\-]*"
_EN = regex.compile(
    rf"(?<![\p{{L}}\d.,\-])(?:(?i:Flat|Apt\.?|Apartment|Unit|Suite|Room) \d+\w?, )?\d{{1,5}}[A-Za-z]?(?:[-–]\d{{1,5}}[A-Za-z]?)? (?:[NSEW]\.? )?(?:{_WORD} ){{1,4}}"
    rf"(?P<type>(?i:{'|'.join(STREET_EN)}))(?![\p{{L}}\d])(?P<dot>\.)?(?P<flat>,? (?i:Flat|Apt\.?|Apartment|Unit|Suite|Floor|#) ?\d+\w?|, \d+(?:st|nd|rd|th) floor)?",
)
_FR = regex.compile(
    rf"(?<![\p{{L}}\d.,\-])\d{{1,4}}(?: ?(?i:bis|ter|quater)\b| ?[A-D](?![\p{{L}}]))?,? (?i:{'|'.join(map(regex.escape, STREET_FR))}) (?:(?i:de la|de l['’]|des|de|du|d['’]|la|le|les) ?)?{_WORD}(?:[ \-](?!(?i:t[ée]l|fax|mail|mob)\b){_WORD}(?=[.;!?]|, \d|\s*$|\s*\n))?(?P<flat>,? (?i:appartement|appt\.?|apt\.?|bât\.?|bâtiment|étage) \w+|, \d+(?:er|e|ème) étage)?",
)
_ES = regex.compile(
    rf"(?<![\p{{L}}\d])(?i:{'|'.join(map(regex.escape, STREET_ES))}) (?:(?i:de la|de los|de las|del|de|la|el|los) )?{_WORD}(?: {_WORD}){{0,2}},? (?i:n[ºo°]\.? ?|núm\. ?)?\d{{1,4}}(?: ?[A-Za-z](?![\p{{L}}\d]))?(?P<flat>, \d{{1,2}}[ºª°](?: ?[A-Z](?!\p{{L}})| (?i:izq|dcha|izda|derecha|izquierda)\.?)?|, (?:bajo|piso|portal|esc\.) ?\w*)?",
)
_IT = regex.compile(
    rf"(?<![\p{{L}}\d])(?i:{'|'.join(STREET_IT)}) (?:(?i:della|delle|dei|degli|del|dello|di|da|das|do|dos|de) )?{_WORD}(?: {_WORD}){{0,2}},? (?i:n[º°]\.? ?)?\d{{1,4}}(?:/?[A-Za-z](?![\p{{L}}\d]))?(?P<flat>,? (?i:interno|int\.|scala|piano|apto\.?) ?\w+)?",
)
_DE = regex.compile(
    rf"(?<![\p{{L}}\d])(?:(?:Am|An der|Im|In der|Zum|Zur|Auf dem|Alte|Neue|Obere|Untere) )?(?:\p{{Lu}}[\p{{L}}\-]*(?i:{'|'.join(map(regex.escape, STREET_DE))})|{_WORD} (?i:Straße|Strasse|Str\.|Weg|Allee|Platz|Gasse)) \d{{1,4}}(?: ?[a-z](?![\p{{L}}\d]))?(?: ?[-–] ?\d{{1,4}}[a-z]?)?(?P<flat>,? (?i:Hinterhaus|Vorderhaus|Seitenflügel|Rückgebäude|\d+\. (?:OG|Stock|Etage)|EG|Whg\.? \d+|Wohnung \d+))?",
)
_RU = regex.compile(
    rf"(?<![\p{{L}}\d])(?:(?i:{'|'.join(map(regex.escape, STREET_RU))}) {_WORD}(?: {_WORD})?|{_WORD}(?:[ \-]{_WORD})? (?i:{'|'.join(map(regex.escape, STREET_RU))})),? (?:(?i:д\.|дом) ?)?\d{{1,4}}(?: ?[а-я](?![\p{{L}}\d]))?(?:/\d+)?(?P<flat>(?:,? (?:корп\.|корпус|к\.|стр\.) ?\d+)?(?:,? (?:кв\.|квартира|оф\.) ?\d+)?)",
)
_AFTER_EN = regex.compile(r" (?:Market|Station|Bridge|Festival|Fair|signs?)\b", regex.I)
_ADDRESS = {"en": _EN, "fr": _FR, "es": _ES, "de": _DE, "ru": _RU, "it": _IT}


def _address(text: str, kind: str, start: int, end: int) -> Span | None:
    pattern = _ADDRESS[kind]
    lo = max(0, start - 70)
    for m in pattern.finditer(text, lo, min(len(text), end + 60), overlapped=True):
        if not (m.start() <= start + 1 and m.end() >= end - 1):
            if m.start() > start + 1:
                break
            continue
        if kind == "en":
            if m["dot"] is None and m["flat"] is None and _AFTER_EN.match(text, m.end()):
                continue
            words = regex.sub(r"^(?:\w+\.? \d+\w?, )?\S+ (?:[NSEW]\.? )?", "", m[0]).split()
            if any(w.islower() and w not in ("of", "the") for w in words[:-1]):
                continue
            if m["dot"] and m["type"].lower() != "rd" and not m["flat"]:
                # else the dot ends the sentence
                if m["type"].lower() not in SHORTENED or text[m.end() : m.end() + 1] not in (";", ",", "."):
                    return m.start(), m.start("dot"), "address"
        return m.start(), m.end(), "address"
    return None


# ---- names --------------------------------------------------------------------------------------------------------

_PART = r"(?:[DdOoLl]['’])?\p{L}[\p{L}\p{M}]*"
_TOKEN = rf"{_PART}(?:-{_PART})*"
_INITIALS = r"(?:\p{Lu}\.(?:[ \-]?\p{Lu}\.)*)"
#: given name or initials, more initials, particles, surname
_GIVEN_FIRST = regex.compile(rf"(?P<given>{_INITIALS}|{_TOKEN})(?: {_INITIALS})?(?P<particle> {PARTICLES})?[ \u00a0](?P<surname>{_TOKEN})", regex.I)
_NO_SPACE = regex.compile(r"\S+")
_SURNAME_FIRST = regex.compile(rf"(?:(?P<particle>{PARTICLES}) )?(?P<surname>{_TOKEN}), (?P<given>{_TOKEN}|{_INITIALS})(?: {_INITIALS})?", regex.I)


def _shape(word: str) -> str:
    letters = [c for c in word if c.isalpha()]
    if all(c.isupper() for c in letters):
        return "upper"
    return "title" if letters and letters[0].isupper() else "lower"


def _plausible(m: regex.Match, lower: bool) -> bool:
    given, surname = m["given"], m["surname"]
    if len(surname.strip("-'’")) < 2 or (len(given) < 2 and "." not in given):
        return False
    if given.lower() in NO_GIVEN or surname.lower() in NO_GIVEN or surname.lower() in ORGANISATION or given.lower() in ORGANISATION:
        return False
    shapes = {_shape(surname)} | (set() if "." in given else {_shape(given)})
    return shapes != {"lower"} and "lower" not in shapes or (lower and shapes == {"lower"})


def _name_at(text: str, at: int, lower: bool, after: regex.Pattern | None = None) -> tuple[int, int] | None:
    """A name that begins at ``at``: surname first where that is written in capitals before a comma."""
    options = []
    if (m := _SURNAME_FIRST.match(text, at)) and _plausible(m, lower) and (_shape(m["surname"]) == "upper" or after is not None):
        options.append(m)
    if (m := _GIVEN_FIRST.match(text, at)) and _plausible(m, lower):
        options.append(m)
    for m in options:
        if after is None or after.match(text, m.end()):
            return m.start(), m.end()
    return None


_NEXT = regex.compile(r"[ \u00a0](\p{Lu}[\p{L}'’\-]*)")
_BEFORE = regex.compile(r"(\p{L}[\p{L}'’.\-]*)[ \u00a0]\Z")
_WORD_AT = regex.compile(r"\p{L}[\p{L}'’\-]*")
_AFTER_ROLE = regex.compile(r"(?: (?:is|was|are|named|called|ist|war|heißt|est|s'appelle|es|era|se llama)|,|:)? ", regex.I)
_ENDED = regex.compile(r"\s*[,.;!?]|\s*$")
_BREAK = regex.compile(r"[ \t\u00a0\u200b]*(?:\r?\n[ \t]*)*")


def _known(text: str, at: int) -> tuple[int, int] | None:
    """A name that begins with a common given name, of which there may be several. What belongs to the name of a place or an
    organisation is none: a word for places before it, a word for organisations or streets after it."""
    got = _name_at(text, at, False)
    if not got:
        return None
    stop = got[1]
    while (last := text[at:stop].rsplit(" ", 1)[-1].lower()) in GIVEN and (more := _NEXT.match(text, stop)) and more[1].lower() not in NO_GIVEN | ORGANISATION:
        stop = more.end()
    if (more := _NEXT.match(text, stop)) and more[1].lower().rstrip("'’") in ORGANISATION:
        return None
    before = _BEFORE.search(text, max(0, at - 24), at)
    if before and before[1].lower() in PLACES | ORGANISATION:
        return None
    # within a heading or shouted text capitals say nothing
    if text[at:stop].isupper() and (before and before[1].isupper() or more and more[1].isupper()):
        return None
    if before and more and before[1][0].isupper() and before[1].lower() not in NO_GIVEN:
        return None
    return at, stop


def _presented(text: str, at: int) -> tuple[int, int] | None:
    """A capitalised name after a word for a person; the next word is no part of a longer name."""
    first = _WORD_AT.match(text, at)
    got = _name_at(text, at, False) or (_name_at(text, at, True, _ENDED) if first and first[0].lower() in GIVEN else None)
    if not got or text[at:got[1]].isupper():
        return None
    more = _NEXT.match(text, got[1])
    words = [w.lower() for w in regex.split(r"[ \u00a0]", text[at : got[1]])]
    return None if more or words[0] in PLACES or words[-1] in PLACES else got


_TWO_INITIALS = regex.compile(rf"(?<![\p{{L}}.])\p{{Lu}}\.(?:[ \-]?\p{{Lu}}\.)+ ((?:[DO]['’])?\p{{Lu}}\p{{Ll}}+(?:-\p{{Lu}}\p{{Ll}}+)?)(?![\p{{L}}])")
_ZH_VERB = regex.compile(rf"(?:见到了?|见过|遇到了?|联系|采访|认识|感谢|告诉|询问|邀请|名叫|我叫|叫做|我是|他是|她是)([{SURNAMES_ZH}]\p{{Han}}{{1,2}})(?=[，。！？、；,.!?\s]|$|的|说|先生|女士)")
_ZH_TITLE = regex.compile(rf"(?<![\p{{Han}}])([{SURNAMES_ZH}]\p{{Han}}{{1,2}})(?=先生|女士|小姐|老师|医生|经理)")


@lru_cache(maxsize=64)
def _following(after: str) -> regex.Pattern:
    return regex.compile(after, regex.I)


#: between the cells of a record
_CELL_LEFT = regex.compile(r"(?:;?[ \t]*\r?\n| \| | / )\Z")
_CELL_RIGHT = regex.compile(r">?(?:;?[ \t]*\r?\n| \| | / )")
_CELL_LABEL = regex.compile(
    r"(?:(?<!\p{L})(?:tel|tél|phone|fax|m|t|e-?mail|mail|id|ssn|dni|passport|passeport|pasaporte|инн|паспорт|address|addr|mob)\.?(?: (?:no\.?|n°|nº|number))?[:：]? ?|<|mailto:)*\Z", regex.I
)
_BEGIN = regex.compile(r"(?:^|[\r\n\t\u00a0\u3000\u200b]\s*|[\d)]\s+|[.!?。！？»”\"…:;|/]\s+|[。！？])\Z")
_END = regex.compile(r"\Z|;|[ \t]*[\r\n]| \| | / |\s*[.。!?]|,?(?: +|\u200b)(?=[\p{Lu}\d«\"„“¿¡<+(\p{Han}])|\s+\Z|\s*[\p{Han}\p{So}&]")


def _name_before(text: str, stop: int) -> Span | None:
    """The name in the cell that ends at ``stop``; one in small letters has to fill the cell or its sentence."""
    base = max(0, stop - 90, *(at + len(x) for x in ("\n", " | ", " / ") if (at := text.rfind(x, max(0, stop - 90), stop)) >= 0))
    for w in [m.start() for m in _NO_SPACE.finditer(text, base, stop)][-6:]:
        begins = (w == base and (not w or text[w - 1].isspace())) or bool(_BEGIN.search(text, max(0, w - 6), w))
        got = _name_at(text, w, begins)
        if got and got[1] == stop:
            return got[0], got[1], "name"
    return None


def _cell_names(text: str, spans: list[Span]) -> Iterator[Span]:
    """Names in the cells before and after other personal information."""
    for start, end, _ in spans:
        left = start - len(_CELL_LABEL.search(text, max(0, start - 24), start)[0])
        sep = _CELL_LEFT.search(text, max(0, left - 6), left)
        if sep and (got := _name_before(text, sep.start())):
            yield got
        sep = _CELL_RIGHT.match(text, end)
        if sep:
            at = _name_at(text, sep.end(), True)
            if at and _END.match(text, at[1]):
                yield *at, "name"


#: the same, or any other word
_WORD_END = regex.compile(_END.pattern, regex.I)


def _introduced(text: str, kind: str, more: object, start: int, end: int) -> tuple[int, int] | None:
    """The name that an anchor introduces or begins."""
    if kind == "given":
        inside = start and text[start - 1] in "-'’@._"
        return None if inside else _known(text, start)
    if kind == "name":
        return _name_at(text, end, False) or _name_at(text, end, True, _WORD_END)
    if kind == "sign":
        at = _BREAK.match(text, end).end()
        return None if at == end and text[end - 1] < "\u2e80" else _name_at(text, at, False) or _name_at(text, at, True, _WORD_END)
    if kind == "report":
        lead, after = more
        between = _following(lead).match(text, end)
        if not between:
            return None
        at = between.end()
        if after:
            return _name_at(text, at, True, _following(after))
        return _name_at(text, at, False) or _name_at(text, at, True, _END)
    if kind == "role":
        between = _AFTER_ROLE.match(text, end)
        if between and between[0][0] == "," and (got := _name_at(text, between.end(), True, _following(","))):
            return got  # between commas, in whatever letters
        return _presented(text, between.end()) if between else None
    return _presented(text, end)


# ---- all together -------------------------------------------------------------------------------------------------


def find(text: str | None) -> list[Span]:
    """(start, end, type) of all findings, in order, without overlaps."""
    if not text or text.isspace():
        return []
    low = lowered(text)
    found: dict[str, list[Span]] = {k: [] for k in ("email", "id_number", "phone", "address", "name")}

    def keep(span: Span | None) -> None:
        if span:
            found[span[2]].append(span)

    for last, (size, kinds) in _anchors().iter(low):
        start, end = last + 1 - size, last + 1
        for kind, more in kinds:
            if kind == "at":
                keep(_mail(text, start, end, low[start:end]))
            elif kind == "id":
                keep(_identity(text, low, start, end))
            elif kind in ("name", "sign", "report", "given", "role", "verb"):
                # whole words only, where there are words
                if start and low[start - 1].isalpha() and low[start].isascii():
                    continue
                if kind in ("given", "role", "report") and end < len(low) and low[end].isalpha() and low[end - 1] < "\u2e80":
                    continue
                got = _introduced(text, kind, more, start, end)
                keep(got and (*got, "name"))
            elif kind == "title":
                if start and low[start - 1].isalpha():
                    continue
                got = _name_at(text, end, True)
                keep(got and (*got, "name"))
            else:
                keep(_address(text, kind, start, end))
    found["id_number"] += _checked(text)
    found["name"] += [(*m.span(), "name") for m in _TWO_INITIALS.finditer(text) if (m[1].lower() not in ORGANISATION) and not ((n := _NEXT.match(text, m.end())) and n[1].lower() in ORGANISATION)]
    if not text.isascii():
        found["name"] += [(*m.span(1), "name") for p in (_ZH_VERB, _ZH_TITLE) for m in p.finditer(text)]
    for m in _NUMBERS.finditer(text):
        if m.end() - m.start() >= 8:
            keep(_phone(text, m))
    out: list[Span] = []
    for kind in ("email", "id_number", "phone", "address"):
        out = _merge(out, found[kind])
    out = _merge(out, [*found["name"], *_cell_names(text, out)])
    return sorted(out)


def _merge(kept: list[Span], more: list[Span]) -> list[Span]:
    """Adds spans that overlap none of those kept; of overlapping new ones the longer, then the earlier."""
    if not more:
        return kept
    taken = sorted(kept)
    for s in sorted(set(more), key=lambda x: (x[0] - x[1], x[0])):
        k = bisect.bisect_left(taken, (s[0], s[1], ""))
        if (k < len(taken) and taken[k][0] < s[1]) or (k and taken[k - 1][1] > s[0]):
            continue
        taken.insert(k, s)
    return taken


PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


def redact(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join([*out, text[at:]])


_FOUND = "doc_id bigint, pii_type string, pii_text string"
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("pii_type", pa.string()), ("pii_text", pa.string())])
_REDACTED = "doc_id bigint, redacted string, n_found int"
_REDACTED_ARROW = pa.schema([("doc_id", pa.int64()), ("redacted", pa.string()), ("n_found", pa.int32())])


def _find_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            rows += [(doc, kind, piece) for kind, piece in dict.fromkeys((k, text[s:e]) for s, e, k in find(text))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _FOUND_ARROW.types)], schema=_FOUND_ARROW)


def _redact_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, counts = [], []
        for text in b.column("text").to_pylist():
            spans = find(text)
            texts.append(redact(text, spans) if spans else text)
            counts.append(len(spans))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], schema=_REDACTED_ARROW)


def _corpus(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    return docs.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text"))


def find_personal(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """doc_id, pii_type, pii_text, distinct."""
    return _corpus(docs, doc_id, text).where(F.col("text").isNotNull()).mapInArrow(_find_rows, _FOUND).distinct()


def redact_personal(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """doc_id, redacted, n_found: one row for each row; a null text stays null."""
    return _corpus(docs, doc_id, text).mapInArrow(_redact_rows, _REDACTED)
