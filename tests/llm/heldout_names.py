"""Sentences written apart from the training patterns, with names and addresses marked: [n ...], [a ...]."""

import re

SENTENCES = """Doctor [n O'Brien] is on call tonight.
The keys are with [n Maria del Carmen Fuentes] at the front desk.
Das Büro liegt in der [a Hauptstraße 12], 10115 Berlin.
The Grand Canyon is in Arizona.
El paquete llegó a [a Calle Mayor 15] el lunes.
[n Siobhan O'Connell] drove the bus for thirty years.
Nos vemos en [a Avenida Libertad 220] a las ocho.
Please forward this to [n K. Yamamoto] before Friday.
Unser Lager ist am [a Lindenweg 7] zu finden.
The statue in Trafalgar Square was cleaned in May.
The grant was awarded to Professor [n Adaeze Nwosu].
Lake Superior is larger than Ireland.
Have you seen [n Brigitte Kaltenbach] today?
[n Rosa de la Vega] opened a bakery in Seville.
The minutes were taken by [n Ingmar Thorsen].
Golden Retriever puppies were sold at the fair.
My dentist moved to [a 48 Cherry Tree Lane] in March.
Captain [n Reyes] greeted the crew.
The Eiffel Tower was closed on Monday.
Ich habe gestern mit [n Friederike Baumgart] telefoniert.
Their lawyer, Mr. [n Pemberton], asked for more time.
Le colis est pour [n Étienne Marchand], merci.
She grew up at [a 5 rue Victor Hugo] in Lyon.
[n Tunde Bakare] scored twice in the second half.
The Supreme Court agreed with the State of New York.
Ask [n Wilhelmina Croft] about the rota.
Black Forest cake is served with cream.
Die Rechnung geht an [n Ottokar Weiss], bitte.
We buried him next to his wife [n Philomena].
Sent by [n Juan Carlos Iglesias] from his phone
Our new address is [a 1207 Sunset Boulevard].
The Pacific Ocean covers a third of the planet.
La profesora [n Inés Barragán] explicó la lección.
[n J. R. Whitlock] signed the petition.
Deliver to the back door of [a 77 Mill Road], please.
Microsoft Office was installed on all machines.
[n Cormac McAllister] and [n Niamh Doyle] sang a duet.
The Tour de France begins in Brest.
Tell Ms. [n Okonkwo] that her car is ready.
Die Wohnung in der [a Goethestraße 33] ist frei.
My name is [n Łukasz Nowak] and I work here.
Ms. [n Linda Chen] called.
The invoice was paid by [n Sarah Connor].
[n John Smith] went to Paris.
Yesterday [n Tobias Wren] sent me the keys.
The award goes to [n Ngozi Adeyemi] for her second novel.
Could you tell [n Henrik Solberg] that the meeting is off?
[n Beatrix Holloway] lives next door to us.
I bought the boat from [n Duncan Fairweather] in 1998.
Our neighbour Mr. [n Abernathy] keeps bees.
Dr. [n Vikram Chandran] will operate on Thursday.
The house at [a 14 Willow Lane] has a red door.
Please deliver the books to [a 302 Harbour Road] before noon.
[n Annika Bergström] and [n Oskar Lindqvist] founded the company together.
She was taught by [n Leopold Fennimore] at school.
Contact: [n Mirela Stoica]
Dear [n Gwendolyn Pratt], we are sorry for the delay.
Best regards, [n Emeka Obi]
The tenant, [n Philippa Marsh], has not paid since June.
A man called [n Rufus Delacroix] asked for you.
He moved to [a 9 Orchard Street] with his son.
Her cousin [n Tamsin Yates] teaches music in Leeds.
[n Zoltán Kiss] won the chess game.
They invited [n Amara Okafor] to speak.
According to [n Stellan Vinter], prices will fall.
The witness [n Clarissa Boone] saw nothing.
[n Ignatius Crowe] was born in Dublin in 1931.
Mrs. [n Featherstone] lost her umbrella on the train.
Written by [n Solveig Aas] and translated by [n Marguerite Toussaint].
Our accountant [n Percival Nott] found the mistake.
Prof. [n Aurelio Santini] gave the first talk.
Send the cheque to [n Winifred Oakes], [a 77 Granary Court].
The painting belonged to [n Casimir Radziwill].
[n Ottoline Fry] said she would come at nine.
I have not seen [n Jasper Quill] for years.
Signed by [n Ludmila Horvat] on 3 May.
Mit freundlichen Grüßen, [n Annegret Pohl]
Herr [n Ziegler] kommt morgen.
Frau [n Petra Sommerfeld] wohnt in Köln.
Monsieur [n Garnier] est absent aujourd'hui.
Señora [n Pilar Redondo] trabaja en el banco.
The plumber came to [a 1180 Chestnut Avenue] twice.
Is [n Barnaby Stokes] at home?
The letter was addressed to [n Hildegard Weiss].
[n K. Yamamoto] repaired the clock.
[n Marion T. Hale] chairs the board.
Two of the players, [n Davor Kralj] and [n Nuno Peixoto], were hurt.
The teacher praised [n Élodie Marchand] for her essay.
His sister [n Rosalind Tate] drove the car.
I rent a flat at [a 5 Canal Place].
The weather in Vienna was cold in March.
The European Parliament voted on Tuesday.
We flew from Oslo to Madrid with two children.
The Bank of England raised its rate.
In April the garden is full of birds.
Windows and Python are used in the English course.
The company opened a second shop near the station.
Of all the books, the third is the best.
There are 24 hours in a day and 7 days in a week.
The museum closes at 5 on Sunday.
Der Zug nach Hamburg fährt um neun Uhr ab.
Die Kinder spielen im Garten hinter dem Haus.
Le train pour Lyon part à huit heures.
La biblioteca abre el lunes por la mañana.
Chapter 4 describes the Second World War in Africa.
Version 3.1 was released under the MIT License.
The price was 40 Euro for 12 bottles.
Microsoft and Siemens signed a contract in Berlin.
Last Christmas it snowed for three days.
No one knew why the lamp went out.
It rained. Then the sun came out. Nobody cared.
He studied German and History at Oxford University.
Please read the Terms and Conditions first.
Top 10 Tips For A Better Garden
The road to the north was closed.
Our flight left Lisbon at 14 hours.""".split("\n")


def parsed():
    """(text, spans as (kind, begin, end)) of each sentence."""
    for line in SENTENCES:
        text, spans, at = "", [], 0
        for m in re.finditer(r"\[([na]) ([^\]]*)\]", line):
            text += line[at : m.start()]
            spans.append(({"n": "name", "a": "address"}[m[1]], len(text), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        yield text + line[at:], spans
