"""Composed texts with known mentions, on which the model of personal information is trained.

Names, towns, streets and numbers are made up letter by letter; sentences come from the lists
below, which are general wording and share no sentence with any table the operator is run on.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from quarrymark.llm.pii_spans import Gazetteer

Gold = set[tuple[int, int, str]]

#: Sentences without personal information; {F} is a family name, {W} a made-up word, {n} digits by count.
PLAIN = (
    "The turbine was serviced twice that winter.", "She prefers early trains and strong tea.", "Nobody had read chapter {1} before the seminar.", "The river rose by {2} centimetres overnight.",
    "Voucher no. {3}-{2}-{4} had expired.", "Lot {3} {2} {4} went back to the vendor.", "Her thesis cites paper no. {9} twice.", "Shipment nr. {3}-{2}-{3} is overdue.", "Pallet {2}-{3}-{2} was lifted on 1998-11-02.",
    "Firmware {1}.{2}.{3}.{1} fixes the fan.", "Catalogue number {3}-{1}-{4}-{4}-{1} is out of print.", "Snapshot 20190305-{4} did not start.", "Engine {U}{U}{4} took over from {U}{U}{3}.", "They paid {1} euros @ {1}.{2} a kilo.",
    "Mention @everyone only in emergencies.", "Mail to the office@ inbox is read daily.", "Turnover grew to {1},{3},{3} in {2} weeks.", "Platform {1}, coach {2}, seat {2}.", "The {F} bridge reopened with {5} guests.", "A {F} engine needs no coolant.",
    "Our {F} office moved in spring.", "In {F} county the harvest was late.", "Issue {1} of the {F} gazette is missing.", "Pump no. {9} leaks again.", "Who has counted {2} swans?", "Contract {9}{1} runs until May.", "{F} Institute won the tender.", "The {W} Prize went to nobody.",
    "Skills: Quality Control, Public Speaking", "Education\n", "Work History\n", "Hobbies: chess, rowing", "Three of {3} samples were dry.", "Key Figures {4}/{2}", "Room {3} is free at {2}:{2}.", "Version {1}.{1} broke the import.", "Tolerance is {1}.{4} mm at 10.0.{1}.{2}.", "Old Harbour Museum opens at nine.",
    "Advanced Spreadsheet Course, 2011", "The {F} method halves the error.", "Flight {U}{U}{4} was late.", "We walked {1} miles along Foxglove Road.", "Bin code {9} is taken.", "Protocol {3}-{2}-{4} was superseded.", "Dr. {F} is away.", "Product ID {U}{5} is retired.", "Customer no. {3}/{3}/{4} complained.", "Docket {6}-{4} was filed.",
)
#: ... and in German, with numbers that belong to no street.
PLAIN_GERMAN = ("Am Sonntag {2}, danach am Freitag. ", "Im Sommer 2016, vor der Messe, fiel der Strom aus. ", "Auf Blatt {2}, Zeile {1}. ", "Die Anlage lief {3} Stunden. ")
#: What may stand around a mention of each kind.
AROUND = {
    "email": ("You can reach the editor under {}.", "Send drafts to {} by noon", "inbox: {} (checked twice a week)", "Questions? {}", "Our list server at {} bounced the note.", "<{}>", "Mail {}; replies take a day", "e-mail {}\n"),
    "phone": ("Telephone: {}", "Dial {} and press two.", "Text {} if you are running late", "My mobile is {} these days.", "fax {}\n", "Phone {} (office hours)", "They rang from {} twice.", "handy {}, sonst Post", "WhatsApp me on {}!", "{}\n", "Hotline {};", "reachable at {} most days", "| {} |"),
    "id_number": ("social-security number: {}", "Her passport {} expires soon.", "SSN: {};", "Tax no. {} was entered wrongly", "Steuer-ID {}\n", "driver's license {},", "National ID card {} was scanned.", "insurance number {} (verified)", "NIE {}\n", "He renewed passport number {} in June.", "TIN {},", "Personalausweis {} liegt vor.", "ID no. {};", "personal identity number {} on the form", "Soc sec no {}."),
    "address": ("Deliver everything to {}.", "Registered address: {}\n", "Since autumn I have been living at {}.", "Our clinic at {} closes early.", "Address {}; ring twice", "Please forward post to {} until March.", "Residing at {}\n", "They moved from {} last year.", "{}\n", "Anschrift: {}.", "Invoices go to {}, not by mail."),
    "name": ("Mrs {} opened the meeting.", "Prof. {} will chair it", "Supervisor: {}\n", "I was trained by {} for a year.", "Please ask {} about keys.", "{} joined the board in 2004.", "According to {} the roof is sound.", "Best regards, {}", "Author: {};", "Mr {}, whose term ended, thanked all.", "met {} at the fair", "{}\n", "Referee {}", "Contact {} on Mondays", "Dear {},", "{} wrote the manual.", "Dr. {} agreed.", "Yesterday {} arrived late.", "Later {} apologised.", "Afterwards {} paid.", "Sir {} told the jury so.", "{} said little."),
}
BREAKS = (" – ", " | ", "; ", " / ", "\n", "\t", ", ")


class Maker:
    """Makes random mentions; ``gazetteer`` knows most of the names and towns used."""

    def __init__(self, r: random.Random):
        self.r = r
        self.given = [self.word(2) for _ in range(60)]
        self.family = [self.word(2) + r.choice(["son", "ski", "well", "ford", "er", "ez", "ova"]) for _ in range(60)]
        self.towns = [self.word(2) + r.choice(["ton", "burg", "stedt", "ville"]) for _ in range(14)] + [f"{self.word(1)} {self.word(2)}" for _ in range(8)]
        low = lambda xs: frozenset(x.lower() for x in xs)
        self.gazetteer = Gazetteer(low(self.given), low(self.family), low(self.towns))

    def word(self, k: int) -> str:
        r = self.r
        return "".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiou") + r.choice(["", "", "l", "n", "r", "s", "th"]) for _ in range(k)).capitalize()

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def letter(self) -> str:
        return self.r.choice("ABCDEFGHKLMNPRSTVWZ")

    def filled(self, text: str) -> str:
        text = text.replace("{F}", self.r.choice(self.family)).replace("{W}", self.word(2))
        while "{U}" in text:
            text = text.replace("{U}", self.letter(), 1)
        for n in range(1, 10):
            while f"{{{n}}}" in text:
                text = text.replace(f"{{{n}}}", self.digits(n), 1)
        return text

    def email(self, person: tuple[str, str] | None = None) -> str:
        r = self.r
        g, f = person or (r.choice(self.given), r.choice(self.family))
        who = r.choice([f"{g}.{f}", f"{g[0]}{f}", f"{f}_{g}+x{self.digits(1)}", f"{g}%{f}.{self.digits(4)}", g, f"{g}-{f}"]).lower()
        host, top = self.word(2).lower(), r.choice(["example", "test", "com", "org", "co.uk", "de"])
        spelled = top.replace(".", " (dot) ")
        out = r.choice([f"{who}@{host}.{top}", f"{who}@{host}.{top}", f"{who} @ {host}.{top}", f"{who} (at) {host} (dot) {spelled}", f"{who}[at]{host}[dot]{top.replace('.', '[dot]')}", f"{who}@mx.{host}-it.{top}", f"{who} at {host} dot {top.replace('.', ' dot ')}"])
        return out.upper() if r.random() < 0.1 else out

    def phone(self) -> str:
        d, r = self.digits, self.r
        a, b, c = d(3), d(3), d(4)
        return r.choice([f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}-{b}-{c}", f"+1{a}{b}{c}", f"+44 7{d(3)} {d(6)}", f"07{d(3)} {d(3)} {d(3)}", f"0044 {d(2)} {d(4)} {c}", f"+49 (0){d(2)} {d(5)}-{d(2)}", f"0{d(2)}/{d(7)}", f"+34 {d(3)} {d(3)} {d(3)}", f"0{d(3)} {d(6)}", f"+49 {d(3)} {d(7)}"])

    def id_number(self) -> str:
        d, u, r = self.digits, self.letter, self.r
        return r.choice([d(9), f"{d(3)} {d(2)} {d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(2)}/{d(3)}/{d(5)}", f"{d(3)}/{d(3)}/{d(5)}", f"{d(6)}-{d(4)}", f"{d(8)}-{d(4)}", f"{u()}{u()}{d(7)}", f"{u()}{d(4)}-{d(3)}-{d(2)}", f"{u()}{u()} {d(2)} {d(2)} {d(2)} {self.r.choice('ABCD')}", d(11), f"{u()}{d(8)}", f"{d(8)}{u()}"])

    def address(self) -> str:
        r, d = self.r, self.digits
        town = r.choice(self.towns) if r.random() < 0.85 else self.word(3)
        house, code = r.randint(1, 240), d(5)
        street = f"{self.word(2)} {r.choice(['Lane', 'Row', 'Street', 'Way', 'Road', 'Ave.', 'St', 'Sq', 'Terrace', 'Close', 'Drive', 'Court'])}"
        street = f"{self.word(1)} {street}" if r.random() < 0.15 else street
        german = f"{self.word(r.choice([2, 3]))}{r.choice(['weg', 'zeile', 'str.', 'gasse', 'straße', 'allee'])} {house}" if r.random() < 0.8 else f"{r.choice(['Am', 'Im', 'Zum'])} {r.choice(['Alten ', ''])}{self.word(2)} {house}"
        roman = r.choice([f"Calle {self.word(2)} {house}", f"{house} rue de la {self.word(2)}", f"Via {self.word(2)} {house}", f"Avenida {self.word(1)} {self.word(2)} {house}"])
        out = r.choice([
            f"{house} {street}, {town} {code}", f"{house}{r.choice('abc')} {street}, Unit #{r.randint(1, 12)}, {town}", f"Flat {r.randint(1, 20)}, {house} {street}, {town} {town[:2].upper()}{d(1)} {d(1)}ZX",
            f"P.O. Box {d(3)}, {town} {code}", f"{german}, {code} {town}", f"{german}, {code} {town}", f"{german}\n{code} {town}", f"{house} {street}\n{town} {code}", f"{house} {street} apt {house % 30}b, {town}", f"{roman}, {code} {town}",
            f"{german}, {town}", f"{german}\n{town}", f"{german} {code} {town}", f"{german}, {town} {code}", f"{house} {street}, {town}",
        ])
        return out.lower() if r.random() < 0.08 else out

    def person(self) -> tuple[str, str]:
        """Given and family name: mostly known, sometimes one or none of them."""
        r = self.r
        g, f = r.choice(self.given), r.choice(self.family)
        known = r.random()
        return (g if known < 0.80 else self.word(2)), (f if known < 0.72 or 0.80 <= known < 0.87 else self.word(3))

    def name(self, person: tuple[str, str] | None = None) -> str:
        r = self.r
        g, f = person or self.person()
        i = self.letter() + "."
        f = f"{f}-{r.choice(self.family)}" if r.random() < 0.07 else f
        out = r.choice([f"{g} {f}", f"{g} {f}", f"{g} {f}", f"{f}, {g}", f"{i} {f}", f"{g} {i} {f}", f"{g} de {f}", f"de {f}, {g}", f"{g} {r.choice(self.given)} {f}", f"{g} de la {f}", f"{g} {self.word(2)} de la {f}"])
        known = out.lower().split()[0].strip(",") in self.gazetteer.given | self.gazetteer.family
        return out.upper() if r.random() < 0.12 else out.lower() if known and r.random() < 0.15 and "." not in out else out

    def makers(self) -> dict[str, Callable[[], str]]:
        return {"email": self.email, "phone": self.phone, "id_number": self.id_number, "address": self.address, "name": self.name}


def practice(count: int, seed: int = 11) -> list[tuple[str, Gold, Gazetteer]]:
    """Composed texts with their mentions (start, end, kind) and the gazetteer of their names."""
    r = random.Random(seed)
    out = []
    for n in range(count):
        if n % 50 == 0:
            maker = Maker(r)
            make = maker.makers()
        text, gold = maker.filled(r.choice(PLAIN_GERMAN)) if r.random() < 0.06 else "", set()
        for _ in range(r.randint(2, 6)):
            draw = r.random()
            if draw < 0.42:
                text += maker.filled(r.choice(PLAIN))
            elif draw < 0.56:  # a signature: several mentions in a row, of one person
                person = maker.person()
                made = [(k, maker.email(person) if k == "email" else maker.name(person) if k == "name" else maker.phone()) for k in r.sample(["email", "phone", "name"], r.randint(2, 3))]
                gap = r.choice(BREAKS)
                for i, (k, m) in enumerate(made):
                    text += gap if i else ""
                    gold.add((len(text), len(text) + len(m), k))
                    text += m
            else:
                kind = r.choice([*AROUND, "name", "address"])
                before, after = r.choice(AROUND[kind]).split("{}")
                m = make[kind]()
                text += before
                gold.add((len(text), len(text) + len(m), kind))
                text += m + after
            text += r.choice([" ", " ", "\n", "\n* "])
        out.append((text, gold, maker.gazetteer))
    return out
