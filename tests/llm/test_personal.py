import pytest
from pyspark.sql import functions as F

from factloom.llm import personal as P

from personal_held_out import HELD_OUT, SECOND


def of(text, kind=None):
    return [text[s:e] for s, e, k in P.find(text) if kind in (None, k)]


MAILS = ["anna.lee@example.org", "A_B+x7@MAIL.EXAMPLE.COM", "joe(at)site.test", "joe.b [at] site [dot] example [dot] org", "joe @ site.net", "x-y＠site.invalid", "kim+news at site dot com"]
PHONES = ["+44 7700 900 311", "+44 (0)20 7946 0053", "+33 1.99.00.36.54", "555 121 199", "01 99 00 39 48", "030 23125 640", "0044 7700 900500", "+49 30 23125-193", "+13035550121", "(202) 555 0155", "+1 (617) 555-0125", "415.555.0115", "303-555-0198", "(030) 23125/519", "07700 900263", "1 713 555 0187", "617 – 555 – 0154"]
IDS = [("SSN", "921-10-9342"), ("Her tax ID is", "99 022 578 300"), ("passport no.", "PX8243801"), ("the ID card", "QQ 79 62 14 C"), ("DNI", "99327077-D"), ("ИНН", "00 00 170157"), ("护照号：", "px-2317-329"), ("Ausweisnummer:", "QQ014998A")]
STREETS = ["155-157 Lantern Close", "51B Quarry Bend Lane", "221 N Old Ferry Ave", "Flat 6, 94 Suzesi Terrace", "107 Trepadi Street, Apt 9", "34 Copper Wharf Rd.", "Avda. de Dolukle, 164, 2º B", "Calle Drobava 81", "C/ Rokelo 94", "Plaza Klutebri, nº 64", "109 rue de Traziko", "15 bis, avenue des Sudekles", "181, place Bapobre", "4 bd Doditru", "Tibebrustr. 192", "Vitrekiallee 153, Hinterhaus", "Am Klaklidiplatz 45", "Vonitoweg 144c", "ул. Batreno, д. 20", "улица Zipifo, дом 192, кв. 22", "Gitrukla пер., д. 87", "пр-т Satadri, 24"]
NAMES = ["Anna Lindsen", "A. Lindsen", "Zoë B. Lindsen", "LINDSEN, Anna", "Anna-Olga Lindsen-Brann", "Dario van der Lindsen", "Pavel O'Lindsen", "ANNA LINDSEN", "anna lindsen", "VAN DER LINDSEN, Anna", "Анна Линдова"]


@pytest.mark.parametrize("mail", MAILS)
def test_mail(mail):
    for text in (f"Write to {mail} before Friday.", f"<{mail}>", f"mailto:{mail}.", f"Mail: {mail}\nNobody knew", f"请写信至 {mail} 。"):
        assert of(text, "email") == [mail]


@pytest.mark.parametrize("phone", PHONES)
def test_phone(phone):
    for text in (f"Call {phone} after six.", f"phone {phone}, ext. 12 The", f"m: {phone}", f"电话：{phone} 。", f"Anna Lind;\n{phone};\nx"):
        assert of(text, "phone") == [phone]


@pytest.mark.parametrize("label,number", IDS)
def test_identity(label, number):
    for text in (f"{label} {number}.", f"1 percent. {label} {number} expired", f"a@b.test | {label} {number} | x"):
        assert of(text, "id_number") == [number]


@pytest.mark.parametrize("street", STREETS)
def test_address(street):
    for text in (f"Address: {street}", f"We live at {street}; 99057 Nistadro.", f"a@b.test;\n{street};\n+44 7700 900 311"):
        assert of(text, "address") == [street]


@pytest.mark.parametrize("name", NAMES)
def test_name(name):
    for text in (f"The tenant, {name}, moved out.", f"Contact: {name}", f"Mit freundlichen Grüßen, {name}\nDie", f"Yesterday {name} called twice.", f"Mme {name} a signé.", f"{name};\na@b.test;\nx", f"x. a@b.test | {name} | +44 7700 900 311"):
        assert of(text, "name") == [name]


@pytest.mark.parametrize(
    "text",
    [
        None, "", "  \n", "look at rebiva dot by dot", "5 @ 8.61 each", "Ping @kobuda on the board.", "Order no. 862-14-0097 shipped.", "Ticket 876 599 7131 closed.", "ISBN 978-0-00-792480-0",
        "Version 6.337.3516 is out.", "Total: 7 807 674.00 credits", "Seen at 2021-02-17 17:58:27.", "Tariff line 9097.17.23 applies.", "3.14159265358979323846", "Grid 03.2774, -82.8652", "38 Road signs were replaced.",
        "Vezopu Street Market opens at 7.", "Dear Gipoklu Cooperative, thanks.", "Part PX-79 fits.", "Flight QX 0680 left gate 20B.", "Regards, Kemotro Railways", "Between 1958 and 1963, the clock tower", "Checksum 050d7ca327575897",
    ],
)
def test_no_cases(text):
    assert P.find(text) == []


def test_redaction_keeps_the_rest():
    text = "Dr. Anna Lindsen, 34 Copper Wharf Rd.; call +44 7700 900 311 or a.l@example.org (SSN 921-10-9342)."
    assert P.redact(text, P.find(text)) == "Dr. [NAME], [ADDRESS]; call [PHONE] or [EMAIL] (SSN [ID_NUMBER])."


def test_rows(spark):
    long = "filler text " * 100_000 + "Write to a.b@example.org now. " + "x" * 500_000
    data = [(1, None, "c"), (2, "", "c"), (3, "a@b.test a@b.test", "c"), (3, "a@b.test", "c"), (4, long, "c"), (None, "c@d.test", "c")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, pii_text string")
    got = sorted(map(tuple, P.find_personal(df, F.col("doc_id"), F.col("text")).collect()), key=repr)
    assert got == [(3, "email", "a@b.test"), (4, "email", "a.b@example.org"), (None, "email", "c@d.test")]
    redacted = {r.doc_id: (r.redacted, r.n_found) for r in P.redact_personal(df.where("doc_id < 3"), F.col("doc_id"), F.col("text")).collect()}
    assert redacted == {1: (None, 0), 2: ("", 0)}
    assert P.find_personal(df.limit(0), F.col("doc_id"), F.col("text")).count() == 0


def test_offsets_survive_letters_that_change_length():
    text = "İİİ Write to a@b.test"
    assert of(text) == ["a@b.test"]


def counts(sentences):
    right = missed = false = 0
    for text, wanted in sentences:
        got = {text[a:b] for a, b, _ in P.find(text)}
        right, missed, false = right + len(got & set(wanted)), missed + len(set(wanted) - got), false + len(got - set(wanted))
    return right, missed, false


def test_sentences_outside_the_tables():
    right, missed, false = counts(HELD_OUT + SECOND)
    assert right / (right + missed) >= 0.9 and right / (right + false) >= 0.9


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("jöhn.doe@example.org wrote", ["jöhn.doe@example.org"]),
        ("mail o'brien@example.com now", ["o'brien@example.com"]),
        ("Write to 'kim@example.com' soon", ["kim@example.com"]),
        ("jane (dot) doe (at) example (dot) com", ["jane (dot) doe (at) example (dot) com"]),
        ("Send it to max@bücher.example please", ["max@bücher.example"]),
        ("John Smith and his wife Anna Brown", ["Anna Brown", "John Smith"]),
        ("Anna Maria Gonzalez paid", ["Anna Maria Gonzalez"]),
        ("Maria Gonzalez Street is closed. San Pedro de Atacama is dry.", []),
        ("CPF 529.982.247-25, not 529.982.247-26", ["529.982.247-25"]),
        ("999-12-3456 and 123-00-4567", []),
        ("昨天我见到了王小明", ["王小明"]),
        ("THE OVEN IN PIERRE NEEDS WORK", []),
    ],
)
def test_boundaries(text, wanted):
    assert sorted(text[a:b] for a, b, _ in P.find(text)) == wanted
