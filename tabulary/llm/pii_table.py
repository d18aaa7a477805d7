"""The small labelled table that the random field for names and addresses learns from.

Sentence patterns are filled with names, addresses, organisations, places and dates by a
seeded generator. Half of all names are made up of syllables, so that the field learns
shapes and contexts and not only the listed names. Slots: {n} a person, {a} an address, {g}, {s} and {f}
one of a German, Spanish or French form (labelled); {o} an organisation, {c} a place, {m} a day or month, {p} another proper noun,
{w} one to three made-up small words (not labelled).
"""

from __future__ import annotations

import random
import re

GIVEN = """James Mary Robert Patricia Michael Jennifer William Elizabeth David Susan Richard Jessica Thomas Sarah Daniel Karen Matthew Nancy Anthony Lisa
Mark Betty Paul Sandra Andrew Ashley Kenneth Emily Kevin Donna Brian Michelle George Carol Edward Amanda Ronald Melissa Anna Peter Hans Klaus Jürgen
Ingrid Sabine Wolfgang Luis Carlos José María Carmen Javier Claire Jean Pierre Sophie Camille Luc Ivan Olga Dmitri Natalia Omar Fatima Ahmed Mehmet Ayşe
Wei Mei Hiroshi Yuki Raj Priya Sanjay Chen Łukasz Agnieszka Eva Lars Björn Astrid Jan Piet Giulia Marco Paolo Chiara John Jane Linda Laura Martin Helen""".split()
FAMILY = """Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Wilson Anderson Taylor Moore Jackson Lee Perez Thompson
White Harris Clark Lewis Robinson Young King Wright Scott Torres Nguyen Hill Flores Green Adams Nelson Baker Hall Campbell Mitchell Carter Müller Schmidt
Schneider Fischer Weber Becker Hoffmann Keller Brandt Dubois Moreau Laurent Lefèvre Petit Rossi Russo Ferrari Kowalski Nowak Petrov Ivanov Yılmaz Demir
Kim Park Tanaka Suzuki Singh Patel Kumar Khan Ali Hassan Silva Santos Oliveira Jansen Andersson Larsen Øster Doe Walker Lund Chang Wang Li Ortega""".split()
CITIES = "California Bavaria Scotland Ohio Andalusia Munich Zürich London Paris Berlin Madrid Leeds Chicago Boston Vienna Rome Oslo Lisbon Dublin Texas France Germany Europe Spain Africa India Hamburg Lyon Seville Tokyo".split()
TITLES = ("mr", "mrs", "ms", "dr", "prof", "miss", "sir", "herr", "frau", "señor", "señora", "madame", "monsieur", "doctor", "professor", "captain", "judge", "lord", "lady", "don", "doña", "profesor", "profesora", "doctora", "fräulein")
STREETS = "Street Road Lane Avenue Drive Court Place Square Boulevard Way St Rd Ave Blvd".split()
_ORGS = ("Acme Corporation", "Google", "the Red Cross", "Oxford University", "the European Union", "Northwind Traders", "the Supreme Court", "Deutsche Bank", "the World Bank",
         "Apache Software Foundation", "the Ministry of Health", "City Council", "Parliament", "the Royal Society", "Microsoft", "Siemens", "Le Monde", "Real Madrid")
_DAYS = "Monday Tuesday Friday Sunday January March April June July September October December Easter Christmas".split()
_NOUNS = ("Internet", "English", "French", "German", "Bible", "Section", "Chapter", "Table", "Figure", "Version", "License", "Apache License", "MIT License", "GNU General Public License",
          "Creative Commons", "Windows", "Python", "Java", "Article", "Annex", "World War", "Renaissance", "Buddhism", "NATO", "PDF", "South", "North Sea", "River Thames", "Mount Everest", "Great Wall", "Atlantic Ocean", "Indian Ocean", "Lake Geneva", "Lake Victoria", "Leicester Square", "Times Square", "Red Square", "Buckingham Palace", "Golden Gate Bridge",
          "Brooklyn Bridge", "Rocky Mountains", "Yellowstone Park", "Hyde Park", "Central Park", "Sherwood Forest", "Labrador Retriever", "Grand Hotel", "Big Ben", "Brandenburg Gate", "Sagrada Familia", "Giro d'Italia", "High Court", "New Jersey", "New Zealand")

PATTERNS = """My name is {n} and I work here . | I am {n} , the new teacher . | This is {n} speaking . | Please contact {n} for details . | Please ask for {n} at the desk .
Dear {n} , thank you for your letter . | Dear Mr. {l} , we received your order . | Hi {n} , how are you ? | Hello {n} , welcome to {o} . | Kind regards , {n} | Regards , {n} | Sincerely , {n} | Best wishes , {n}
Mr. {l} signed the form . | Mrs. {l} lives at {a} . | Ms. {l} called yesterday . | Dr. {n} will see you on {m} . | Prof. {l} of {o} spoke first . | Miss {l} was not at home . | Sir {n} opened the bridge .
Herr {l} wohnt in {c} . | Frau {l} hat den Vertrag am {m} unterschrieben . | Mein Name ist {n} und ich komme aus {c} . | Der Brief wurde von {n} geschrieben . | Señor {l} vive en {c} . | Me llamo {n} y soy de {c} .
La carta fue escrita por {n} . | Je suis {n} , de {c} . | Madame {l} habite à {c} . | Monsieur {l} est arrivé . | Le rapport a été signé par {n} . | Das Buch ist von {n} .
{n} went to {c} in {m} . | {n} lives in {c} . | {n} said that the work was done . | {n} was born in {c} . | {n} has been with {o} since {m} . | {n} and {n} were married in {m} . | {n} , {n} and {n} signed the letter .
{n} called again . | {n} told me about the plan . | {n} is a doctor in {c} . | {n} did not answer . | {n} wrote the book . | {n} paid the bill . | {n} won the race on {m} . | {n} works for {o} .
{n} , a lawyer from {c} , spoke first . | The invoice was paid by {n} . | The book was written by {n} in {m} . | The form was signed by {n} . | It was {n} who opened the door . | I met {n} in {c} .
We asked {n} for help . | She married {n} last year . | He works with {n} at {o} . | The car belongs to {n} . | A letter from {n} came on {m} . | Give this to {n} , please . | I spoke with {n} about it . | The room of {n} is empty .
Send it to {n} , {a} . | The parcel goes to {a} . | Ship to: {a} | Signed by {n} | Name: {n} | Name: {n} , Address: {a} | Address: {a} | Patient: {n} | Employee: {n} | Author: {n} | Contact: {n} | Customer {n} ordered two chairs .
I live at {a} . | Our office is at {a} in {c} . | They moved to {a} last year . | The shop at {a} is closed . | Meet me at {a} . | {n} lives at {a} . | The house at {a} was sold . | Return address: {a} , {c}
Call {n} after noon . | written by {n} in the spring | photo by {n} | translated by {n} | according to {n} , the plan failed | thanks to {n} for the help | my friend {n} came too | her brother {n} is ill | his wife {n} and their son {n}
the painter {n} died in {c} | president {n} met the press | our manager {n} will reply | Judge {l} ruled on {m} . | Captain {l} left the ship . | Officer {l} wrote the report . | Nurse {n} took care of me . | Attorney {n} filed the case .""".replace("\n", " | ").split(" | ")
PATTERNS_MORE = """Doctor {l} is on duty today . | Professor {n} gave the talk . | Captain {l} thanked the crew . | Our lawyer , Mr. {l} , agreed . | The teacher , Mrs. {l} , smiled . | Ask Doctor {l} about it . | Lady {n} opened the fair .
{n} sold the farm last year . | {n} wrote three novels . | {n} runs a shop near {c} . | {n} opened the second door . | {n} drove a van for ten years . | {n} scored in the first half . | {n} sings in the choir . | {n} repaired the roof . | {n} and {n} run the shop .
{n} has two daughters . | {n} never came back . | {n} , who taught history , retired in {m} . | The prize went to {n} . | The key is with {n} at the desk . | The notes were taken by {n} . | Sent by {n} from the office | Tell {n} that the car is ready . | Ask {n} about the rota .
Wir haben mit {n} gesprochen . | Ich traf {n} im Park . | Die Rechnung geht an {n} . | Bitte rufen Sie {n} an . | Das Paket ist für {n} . | {n} arbeitet seit {m} bei {o} . | Der Vertrag mit {n} endet im {m} . | Gestern kam {n} zu uns . | Herr {n} und Frau {l} kamen zusammen .
Das Geschäft liegt in der {g} . | Wir wohnen in der {g} in {c} . | Die Werkstatt ist am {g} zu finden . | Anschrift: {g} , 80331 {c} | Das Haus in der {g} wurde verkauft . | Treffpunkt ist {g} , 50667 {c} . | Die Praxis in der {g} ist geschlossen . | Er zog in die {g} .
El libro es de {n} . | Hablé con {n} ayer . | La doctora {n} llegó tarde . | El profesor {n} explicó el plan . | Un regalo para {n} , por favor . | {n} vive en {c} desde {m} . | Le pagué a {n} el lunes . | Vivimos en {s} desde {m} . | La tienda está en {s} . | El paquete va a {s} . | Nos vimos en {s} a las diez .
J'ai parlé avec {n} . | La lettre est pour {n} . | {n} habite à {c} . | Nous habitons au {f} . | Le magasin est au {f} à {c} . | Elle travaille avec {n} depuis {m} . | Monsieur {n} a signé . | I live at {f} in {c} . | The office at {s} is closed . | We met at {g} in {c} .""".replace("\n", " | ").split(" | ")
PATTERNS += PATTERNS_MORE
PLAIN = """The {p} is in {c} . | The {p} is near {c} . | The {p} was closed on {m} . | We saw the {p} from the train . | The {p} is larger than {c} . | A walk through {p} takes an hour . | {p} is far from {c} . | The {p} covers much of the land . | {p} puppies were sold . | {o} agreed with {o} . | The statue in {p} was cleaned in {m} .
The report was sent to {o} on {m} . | In spring the rivers rise and the fields are wet . | Of these the first was the largest . | And then it rained for 12 days . | There were 35 people at the meeting . | On the table stood a bowl of fruit .
OF THE RIVER AND THE SEA | Every Word In This Title Has A Capital | Le chat dort sur la chaise . | Der Hund lief durch den Garten und die Katze schlief . | Los perros corren por la calle . | Was it 4 or 9 ? | At the time 77 of them were old .
This work is licensed under the {p} . | Licensed under the {p} , {p} 2.0 | licensed under the GNU General Public License , version 3 . | Licensed under the Apache License , Version 2.0 . | Released under the MIT License . | Licensed under CC BY-SA 4.0 . | Version 2.0 of the file was read in 2004 . | A | B | C | D | Und die Stadt war groß . | token = 4f2a91c03b | Is and the of when there were with . | Anden . Thnt of erin the onha .
He flew from {c} to {c} on {m} . | {o} opened an office in {c} . | The {p} was written in {m} . | {c} is a large city . | In {c} the summer is hot . | {m} was cold . | On {m} we went home . | {o} said that profits rose . | The {p} is taught in {c} .
The letter came from {o} . | She works for {o} . | He studied {p} in {c} . | The train to {c} leaves at 9 . | They read {p} and {p} . | See {p} 4 for details . | By {m} all was done . | From {c} we drove north . | The war ended in {m} 1945 .
Die Firma {o} sitzt in {c} . | Im {m} war das Wetter schlecht . | Der Mann kaufte ein Haus mit Garten . | Die Frau las ein Buch über Geschichte . | Das Kind spielt im Park mit dem Ball . | En {m} llueve mucho . | La ciudad de {c} es grande . | En {c} il fait froid .
Le prix de {o} est connu . | It was paid by {o} . | The bridge was built by {o} in {c} . | We thank {o} for the help . | The meeting with {o} is on {m} . | I saw 40 birds near {c} . | Chapter 3 : The Long Road Home | The first word of a sentence is large .
Thank you for your letter . | Please reply by {m} . | Call the office after noon . | They moved to {c} last year . | Our office is in {c} . | The shop is closed . | Kind regards | Total: 45 items | There are 12 rooms on 3 floors . | 24 hours a day | The train leaves at 14 hours . | We waited 3 hours at the gate . | It took 20 minutes . | Trains run at 12 and 18 hours  . | 10 Years Later
We sold 200 cars in {m} . | Price 15 Euro each . | Top 10 Songs of the Year | 7 Days in {c} | Copyright 2004 {o} | All Rights Reserved | Terms and Conditions | Frequently Asked Questions | Click Here to Read More | New York Times""".replace("\n", " | ").split(" | ")
_SYLLABLES = ("ba", "con", "der", "el", "fi", "gan", "ho", "il", "ra", "ment", "ne", "or", "qui", "st", "tu", "vin", "th", "er", "ö", "é", "ań", "ş", "lo", "mi", "ka", "sen", "rov", "ez")
_SMALL = ("der", "von", "del", "van", "di", "is", "to", "at", "of", "and", "the", "in", "by", "for", "with", "on", "was", "that", "de", "la", "und", "die", "y", "el", "le", "des", "los", "las", "que", "en", "una", "les", "den", "das", "ein", "un", "est", "il", "a", "es")


def _made_up(rng: random.Random, least: int = 1, most: int = 4) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(least, most)))


def _person(rng: random.Random, form: str) -> list[str]:
    given = lambda: rng.choice(GIVEN) if rng.random() < 0.5 else _made_up(rng, 2, 3).capitalize()
    plain = lambda: rng.choice(FAMILY) if rng.random() < 0.45 else _made_up(rng, 2, 4).capitalize()
    family = lambda: rng.choice(("O'", "Mc", "Mac", "D'")) + plain() if rng.random() < 0.08 else plain()
    if form == "l":
        return [family()]
    kind = rng.random()
    if kind < 0.6:
        return [given(), family()]
    if kind < 0.69:
        return [given(), rng.choice("ABCDEFGHJKLMPRSTW") + ".", family()]
    if kind < 0.77:
        return [rng.choice("ABCDEFGHJKLMPRSTW") + ".", rng.choice(FAMILY) if rng.random() < 0.8 else family()]
    if kind < 0.82:
        return [given(), f"{family()}-{family()}"]
    if kind < 0.88:
        between = rng.choice(("de", "van", "von", "del", "di", "de la", "van der")).split()
        return [given(), *([given()] if rng.random() < 0.2 else []), *between, family(), *([family()] if rng.random() < 0.3 else [])]
    if kind < 0.9:
        return [rng.choice("ABCDEFGHJKLMPRSTW") + ".", rng.choice("ABCDEFGHJKLMPRSTW") + ".", family()]
    if kind < 0.94:
        return [given(), given(), family()]
    return [rng.choice(GIVEN)]


def _address(rng: random.Random, form: str = "a") -> list[str]:
    """An address: English mostly, or German ({g}), Spanish ({s}) or French ({f})."""
    number, word = str(rng.randint(1, 1999)), lambda: rng.choice((*FAMILY, "Oak", "Mill", "Old", "High", "River", "Park", "Church", "Elm", "Maple", "Second", "5th", "Station", "Garden", "Lake", "Cherry Tree", "Sunset", "Harbour"))
    kind = rng.random() if form == "a" else {"g": 0.8, "f": 0.9, "s": 0.95}[form]
    made = lambda: _made_up(rng, 1, 3).capitalize()
    if kind < 0.75:
        return [number, *word().split(), *(word().split() if rng.random() < 0.3 else []), rng.choice(STREETS)]
    short = str(rng.randint(1, 199))
    if kind < 0.85:
        stem = rng.choice(("Haupt", "Bahnhof", "Garten", "Schul", "Berg", "Linden", "Wald", "Kirch", "Schiller", "Mozart")) if rng.random() < 0.5 else made()
        return [f"{stem}{rng.choice(('straße', 'strasse', 'weg', 'platz', 'gasse', 'allee'))}", short + rng.choice(("", "", "", "a", "b"))]
    if kind < 0.93:
        return [short, rng.choice(("rue", "avenue", "boulevard", "place", "quai")), *rng.choice(("", "de", "du", "des", "de la")).split(), rng.choice(("Pasteur", "Molière", "République", "Gambetta", "Moulin")) if rng.random() < 0.5 else made()]
    return [rng.choice(("Calle", "Avenida", "Plaza", "Via", "Paseo")), *rng.choice(("", "", "de", "de la", "del")).split(), rng.choice(("Mayor", "Real", "Sol", "Goya", "Colón", "Prado")) if rng.random() < 0.4 else made(), short]


def _filled(rng: random.Random, pattern: str) -> tuple[list[str], list[str]]:
    words, labels = [], []
    for w in pattern.split():
        key = w[1:2] if w.startswith("{") else ""
        if key in tuple("nlagsf"):
            kind, made = ("name", _person(rng, key)) if key in "nl" else ("address", _address(rng, key))
            words += made
            labels += [f"{'I' if i else 'B'}-{kind}" for i in range(len(made))]
            continue
        made = rng.choice({"o": _ORGS, "c": CITIES, "m": _DAYS, "p": _NOUNS}[key]).split() if key in "ocmp" and key else [_made_up(rng) for _ in range(rng.randint(1, 3))] if key == "w" else [w]
        words += made
        labels += ["O"] * len(made)
    # Punctuation that stands alone joins the word before it, as in running text.
    out_words, out_labels = [], []
    for w, y in zip(words, labels, strict=True):
        if w in (".", ",", "?", ":") and out_words:
            out_words[-1] += w if not (w == "." and out_words[-1].endswith(".")) else ""
        else:
            out_words.append(w)
            out_labels.append(y)
    return out_words, out_labels


def _named(rng: random.Random) -> tuple[list[str], list[str]]:
    """A sentence of small and made-up words around a name of two or three words."""
    before, after = ([rng.choice(_SMALL[5:15]) if rng.random() < 0.4 else _made_up(rng, 1, 4) for _ in range(rng.randint(1, 6))] for _ in range(2))
    before[0] = before[0].capitalize()
    name = _person(rng, "n")
    while len(name) < 2:
        name = _person(rng, "n")
    after[-1] += "."
    return before + name + after, ["O"] * len(before) + ["B-name"] + ["I-name"] * (len(name) - 1) + ["O"] * len(after)


def _prose(rng: random.Random) -> list[str]:
    """A sentence of known and unknown words; its first word, and now and then another, is capitalised."""
    many = rng.random() < 0.15
    words = [rng.choice(_SMALL) if rng.random() < 0.3 else _made_up(rng, 1, 5) for _ in range(rng.randint(3, 16))]
    words = [w.capitalize() if i == 0 or (many and rng.random() < 0.25) else w for i, w in enumerate(words)]
    words = [w + "," * (rng.random() < 0.12) for w in words]
    words[-1] += "."
    return words


def _odd(rng: random.Random) -> list[str]:
    """Table rows, repeated words, shouted words and short sentences of unknown words."""
    w = [_made_up(rng, 1, 4) for _ in range(rng.randint(4, 9))]
    shape = rng.randrange(9)
    if shape == 0:
        return " | ".join(x.capitalize() if rng.random() < 0.4 else x + "," * (rng.random() < 0.3) for x in w).split()
    if shape == 1:
        return [(rng.choice(_SMALL) if rng.random() < 0.5 else w[0]).capitalize() + "," * (rng.random() < 0.3)] * rng.randint(2, 24)
    if shape == 2:
        return [w[0].capitalize(), rng.choice(_SMALL), *w[1 : rng.randint(1, 4)]]
    if shape == 3:
        return [x.upper() + "!!" * (rng.random() < 0.5) for x in w]
    if shape == 4:
        return [*w[:3], *[w[3].capitalize()] * rng.randint(3, 12), *w[:2]]
    if shape == 5:
        return [rng.choice(("Is", "From", "At", "To", "The", "By", "In", "Of", "For", "And", "De", "La", "Der", "Die", "Le", "El")), *w[: rng.randint(1, 4)]]
    if shape == 8:
        return [(x.capitalize() if rng.random() < 0.4 else x) + rng.choice(("", "", ".", ",")) + rng.choice(("###", "***", "%%%", "&&&", "$$$")) * (rng.random() < 0.8) for x in w]
    if shape == 6:
        return [rng.choice("ABCDEÉÈÖÑÜOIYA") + ".", w[0].capitalize(), *([rng.choice(_SMALL)] * (rng.random() < 0.6)), *w[1 : rng.randint(1, 4)]]
    return [w[0].capitalize() + rng.choice((".", ",", "")), *w[1:3], w[3].capitalize() + rng.choice((".", ","))]


def labelled_table(seed: int = 1) -> list[tuple[list[str], list[str]]]:
    """(tokens, labels) of some two thousand sentences."""
    rng = random.Random(seed)
    out = [_filled(rng, p) for p in PATTERNS for _ in range(16 if any(x in p for x in ("{a}", "{l}", "{g}", "{s}", "{f}")) else 8)] + [_named(rng) for _ in range(250)] + [_filled(rng, p) for p in PLAIN for _ in range(6)]
    blank = [re.sub(r"\{[nlagsf]\}", "{w}", p) for p in PATTERNS]
    out += [_filled(rng, p) for p in blank for _ in range(2)]
    for _ in range(420):
        out += [(w, ["O"] * len(w)) for w in (_prose(rng), _odd(rng))]
    return [(w, y) for w, y in out if w]


def lexicon() -> tuple[set[str], list[set[str]]]:
    """Words that the field may learn one by one, and lists of words that it learns as one."""
    slots = {"{n}", "{l}", "{a}", "{g}", "{s}", "{f}", "{o}", "{c}", "{m}", "{p}", "{w}"}
    own = {w.strip(".,;:!?()").lower() for p in (*PATTERNS, *PLAIN) for w in p.split() if w not in slots}
    own |= {w.lower() for x in (*_ORGS, *_NOUNS) for w in x.split()} | {"rue", "avenue", "boulevard", "quai", "calle", "avenida", "plaza", "via", "paseo", "de", "van", "von", "del", "di", "al", "bin"}
    lists = [{x.lower() for x in words} for words in (GIVEN, FAMILY, CITIES, _DAYS, STREETS, TITLES)]
    return {w for w in own - lists[4] - lists[5] if w and not w.isdigit()}, lists
