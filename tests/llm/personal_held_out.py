"""Sentences written after the rules and never used to change them: (text, personal information it holds)."""

HELD_OUT = [
    ("Could you forward this to rebecca.stone+invoices@mail.example.co.uk before noon?", ["rebecca.stone+invoices@mail.example.co.uk"]),
    ("Reach Sarah Whitmore on (415) 555-0132 or at home.", ["Sarah Whitmore", "(415) 555-0132"]),
    ("The keys are with our caretaker, Thomas Berger, until Friday.", ["Thomas Berger"]),
    ("Cheers,\nHelen Brookfield", ["Helen Brookfield"]),
    ("Dr. Emily Carter saw twelve patients.", ["Emily Carter"]),
    ("He moved to 17 Chestnut Avenue, Flat 4 in spring.", ["17 Chestnut Avenue, Flat 4"]),
    ("My passport number is X1234567, issued in 2019.", ["X1234567"]),
    ("Version 3.12.4 fixed issue 20394.", []),
    ("The Bodleian Library opens at nine.", []),
    ("Order no. 4489-221 left the depot on 2023-04-11.", []),
    ("Invite Carlos Mendes and Julia Hartmann to the review.", ["Carlos Mendes", "Julia Hartmann"]),
    ("Her husband, Robert Ellison, teaches maths.", ["Robert Ellison"]),
    ("Bitte rufen Sie Herrn Wolfgang Seidel unter 030 901820 an.", ["Wolfgang Seidel", "030 901820"]),
    ("Sie wohnt in der Goethestraße 21, 2. OG.", ["Goethestraße 21, 2. OG"]),
    ("Mein Name ist Katrin Vogel.", ["Katrin Vogel"]),
    ("Der Zug nach Bad Homburg fährt um 12:45.", []),
    ("Mit freundlichen Grüßen\nAndreas Lindner", ["Andreas Lindner"]),
    ("Je m'appelle Nathalie Girard et j'habite 8 rue Victor Hugo.", ["Nathalie Girard", "8 rue Victor Hugo"]),
    ("Appelez Monsieur Antoine Lefèvre au 01 42 68 53 00.", ["Antoine Lefèvre", "01 42 68 53 00"]),
    ("La gare de Lyon est fermée.", []),
    ("Mi vecina Carmen Ruiz vive en Calle Mayor 45, 2º B.", ["Carmen Ruiz", "Calle Mayor 45, 2º B"]),
    ("Su NIE es X1234567L.", ["X1234567L"]),
    ("Escriba a luis [at] correo [dot] example [dot] com.", ["luis [at] correo [dot] example [dot] com"]),
    ("Don Miguel Ortega llegó tarde.", ["Miguel Ortega"]),
    ("Мою соседку зовут Елена Кравцова.", ["Елена Кравцова"]),
    ("Звоните по телефону +7 495 123-45-67.", ["+7 495 123-45-67"]),
    ("Она живёт на ул. Ленина, д. 5, кв. 12.", ["ул. Ленина, д. 5, кв. 12"]),
    ("请联系李建国，电话 138 0013 8000。", ["李建国", "138 0013 8000"]),
    ("张伟先生今天没来。", ["张伟"]),
    ("北京图书馆今天关门。", []),
    ("Grace Holloway's dog barked all night.", ["Grace Holloway"]),
    ("I met Wei Zhang at the station.", ["Wei Zhang"]),
    ("Tell Mehmet Yildiz that the boiler works again.", ["Mehmet Yildiz"]),
    ("Contact person: Aoife O'Sullivan, room 12.", ["Aoife O'Sullivan"]),
    ("SSN: 219-09-9999", ["219-09-9999"]),
    ("The Ohio River rose by 3 metres in 1937-1938.", []),
    ("Kind regards,\nDr Fatima Rahman\nfatima@example.net", ["Fatima Rahman", "fatima@example.net"]),
    ("ISBN 978-3-16-148410-0 is out of print.", []),
    ("National insurance number QQ 12 34 56 C was on the form.", ["QQ 12 34 56 C"]),
    ("Abita in Corso Garibaldi 118.", ["Corso Garibaldi 118"]),
    ("The parcel for Svetlana Morozova came back.", ["Svetlana Morozova"]),
    ("Ask the Red Cross about it.", []),
    ("J. R. Whitfield signed the lease.", ["J. R. Whitfield"]),
    ("call me at +44 (0)20 7946 0018 after six", ["+44 (0)20 7946 0018"]),
    ("Santa Clara Valley had rain.", []),
]

#: written after the last change to the rules, which the sentences above had brought about
SECOND = [
    ("Invoices go to accounts.payable@firma-müller.example only.", ["accounts.payable@firma-müller.example"]),
    ("Nancy Abernathy will open the door.", ["Nancy Abernathy"]),
    ("Please call my sister Ingrid Solberg tonight.", ["Ingrid Solberg"]),
    ("The witness, Gabriel Ferreira, left early.", ["Gabriel Ferreira"]),
    ("Best wishes,\nOluwaseun Adeyemi", ["Oluwaseun Adeyemi"]),
    ("She gave 42 Harbour Street as her address.", ["42 Harbour Street"]),
    ("The Danube Commission met in Budapest.", []),
    ("Ticket 555-0199 is closed.", []),
    ("Herr Jürgen Baumann wohnt Am Anger 7.", ["Jürgen Baumann"]),
    ("Rufnummer: 0171 5554433", ["0171 5554433"]),
    ("Ma collègue Sophie Delacroix arrive demain.", ["Sophie Delacroix"]),
    ("Son numéro de passeport est 12AB34567.", ["12AB34567"]),
    ("La señora Pilar Navarro firmó.", ["Pilar Navarro"]),
    ("Avenida de la Constitución 8, 3º", ["Avenida de la Constitución 8, 3º"]),
    ("С уважением,\nДмитрий Орлов", ["Дмитрий Орлов"]),
    ("Паспорт 4509 123456 выдан в Москве.", ["4509 123456"]),
    ("我叫陈晓东，住在上海。", ["陈晓东"]),
    ("His id card number is 110105199003074514.", ["110105199003074514"]),
    ("Mrs Eleanor Rigby-Jones keeps the spare key.", ["Eleanor Rigby-Jones"]),
    ("I am Yuki Tanaka from flat 3.", ["Yuki Tanaka"]),
    ("The Amazon Basin is wet.", []),
    ("Total: 1 234 567.00", []),
    ("Write tom_hardy99 AT example DOT org.", ["tom_hardy99 AT example DOT org"]),
    ("Prof. Klaus Richter and Dr. Monika Weiss spoke.", ["Klaus Richter", "Monika Weiss"]),
    ("George Washington Bridge is closed.", []),
    ("fax: +39 06 6982 1234", ["+39 06 6982 1234"]),
    ("Rosa's Bakery sells bread.", []),
    ("Thanks for meeting Amit Chatterjee, he liked it.", ["Amit Chatterjee"]),
]
