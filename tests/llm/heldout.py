"""Sentences with names outside the lexicon, in frames that the test tables do not use; * marks a name."""

NAMED = """
Please ask *Ngozi Adeyemi* about the ticket.
I met *Priya Venkataraman* at lunch.
Kontaktieren Sie *Jürgen Weiß* morgen.
signed: *Ngozi Adeyemi*
The minutes were taken by *Carlos Medina* last week.
According to *Fatima Zahra*, the server was down.
*Lena Brandt* will take over the shift.
We forwarded everything to *Olu Bankole* yesterday.
Can you loop in *Sanjay Mehta* on this thread?
The owner of the queue is *Marta Kowalska*.
Ayer hablé con *Lucía Fernández* sobre el informe.
El parche es de *Andrés Villanueva*.
Preguntad a *Inés Robledo* antes de cerrar.
Nous avons parlé avec *Camille Rousseau* ce matin.
Le dossier est chez *Étienne Marchand*.
Gestern rief *Sabine Krüger* an.
Bitte an *Dieter Hoffmann* weiterleiten.
I got the numbers from *Aisha Rahman*.
*Tomasz Wiśniewski* found the leak.
Nobody but *Hiro Tanaka* knows the password.
*Emeka Okafor* and *Linda Petersen* paired on it.
Thanks to *Rachel O'Connor* we shipped.
It turned out that *Mei Ling* had the keys.
The call with *Ahmed Hassan* ran long.
Let *Katarina Novak* know when it is done.
My manager *Pavel Dvořák* approved it.
cc *Grace Mwangi*
She and *Bjorn Eriksson* rewrote the parser.
The patch by *Yuki Sato* fixes it.
J'ai croisé *Solène Girard* au bureau.
Wir haben *Annika Vogel* gefragt.
Me lo contó *Rocío Salgado* por teléfono.
Send it to *Ian McAllister* instead.
*Jean-Luc Moreau* disagreed.
With *Peter J. Lindqvist* on leave, nothing moved.
Have you seen *Ximena Duarte* today?
*Deepak Nair* sends his regards.
The reviewer was *Helga Sørensen*.
I owe *Victor Osei* a coffee.
Only *Nadia Petrova* can restart it.
""".strip().splitlines()

NAMELESS = """
We flew to New York on Monday.
Open Visual Studio and press build.
The United Nations published a report.
Apache Spark reads the table.
The meeting is on Friday March 7.
Project Aurora slipped again.
He studies at Stanford University.
The Golden Gate Bridge was closed.
Die Deutsche Bahn hatte Verspätung.
Das Rote Kreuz half uns.
El Banco Central subió los tipos.
La Casa Blanca no comentó nada.
Use the Quick Start Guide for that.
In San Francisco it rained.
Read The Lord of the Rings.
Press Ctrl and wait.
See Table 4 and Figure 2.
Nous sommes allés à Saint Malo.
Amazon Web Services was down.
The Index Server crashed.
Google Cloud sent an invoice.
Am Montag Morgen regnet es.
Open Source Software is free.
North America grew fastest.
""".strip().splitlines()
