"""The small labelled table the personal-data model is trained on.

Each line is a sentence frame in one of four languages; ``[a|b]`` is a choice. Slots in braces are filled from short
lists and number patterns by a seeded generator, so the labels are exact: E email, P phone, I identity number, A street
address, N personal name are personal; T town, Z postcode, G a given name that is none here, d digits and x the
look-alikes of LOOKALIKES are not. Family names, streets and part of all other words are put together from syllables, so
that the model learns shapes and surroundings, and not words by heart.
"""

from __future__ import annotations

import random
import re

SLOT_TYPES = {"E": "email", "P": "phone", "I": "id_number", "A": "street_address", "N": "person_name"}

FRAMES = {
    "en": """
[Kindly|Please] [hand|give|pass] [this|the keys|the folder] to {title} {N} [when he arrives|at reception|upstairs|in person].
[I am|This is|We are expecting] {N} [from the north office|, the new tenant|and two guests].
{N} [called twice|has the spare key|wrote the report|will pick it up|paid by card|lives next door|asked for a refund].
[Painted|Written|Sent|Approved|Checked|Baked|Sold|It was made|This was filed] by {N} [in May|on paper|last spring|this week|].
[A gift|A call|News|The claim|This letter] from {N} [came|arrived|was opened] [late|today|last month].
{N} [approved|opened|ordered|bought|repaired|returned|forgot] [the lease|a lamp|the car|our letter|two chairs].
[The caller|My neighbour|The patient|Our buyer|The author] [was|is|gave the name] {N}[.|, as far as I know.| and nobody else.]
[Signed|Truly yours|With thanks|Warmly],\n{N}
[Best wishes|Yours sincerely|Many thanks|All the best|Sincerely|Cheers],\\n{N}
[Signed|Attn|Attention|Name|Full name|Recipient|Sender|Author|Customer|Guest]: {N}
[We|They|She] [met|thanked|invited|saw|rang] {title} {N} [on Tuesday|last night|at the fair|in March].
[According to|Thanks to|Together with|On behalf of] {N}[, the part is lost.|, we found it.|, all is well.]
[Account holder|Tenant|Reference person|Doctor] {N} [, room 4|, born in May|, since 2019].
[Mail|Email|E-mail|Inbox|Write to|Reply to|My address online is|Reach us via]: {E}
[Send|Forward|Mail] [it|the file|the scan|your answer|all of it] to {E} [by noon|tonight|instead|and wait].
[Drop|Write] [me|us|him] a [line|note|message] at {E}[.|, please.| whenever you like.]
[The invoice|Every alert|A receipt] went to {E} [by mistake|yesterday|again|, not to me].
[Old|New|Second|Private] [mailbox|mail] {E} [is full|works now|bounced|was hacked].
{E} [wrote to us|is on the list|never answered|gets a copy].
[Ring|Phone|Text|Dial|Reach|Try] [us|him|her|the office|my wife|me] [on|at|under] {P} [before nine|today|any time|if it rains|tomorrow|please].
[Tel no|tel:|tel|Tel no.|phone:|Mob.] {P}
[Mobile|Cell|Phone no.|Fax|Telephone number|Landline|T|Ph.|Hotline] {P}
[Mobile|Cell|Fax|Telephone number|Landline|Work phone|Emergency contact]: {P}
[Mobile|Fax|Office line|Telephone number]: {P} [ext.|extension|x] {d}
[Number|Call number|No.]: {P}
[His|Her|Our|Your|The shop's] number is {P}.
[The number|His new number|Our number|Your number|The office line|Her mobile] [is|was|should be] {P}[.| ext. {d}.| or so.|, extension {d}.]
[Couriers|Guests|Parents] [may|can|should] [dial|call|use|ring|reach|try|text] {P} [ext. {d}|] [at the gate|on the day|for help|before they leave].
[Nobody answers|I left a message|It rang out|They hung up] [at|on|under] {P}[.| again.| so far.]
[SSN|Social security no.|Tax ID|Identity number|Passport no.|Personal number|Insurance number|National ID|ID no.|NI number]: {I}
[SSN|Tax ID|ID card|Insurance no.|Identity card] {I}
[Your|His|Her|The applicant's] [tax number|identity number|insurance number|social security number|national insurance number|ID number] [is|was|reads|ends up as] {I}[.| according to the card.| on file.]
[They want|I entered|Use|Quote|He gave|The clerk noted|It needs] {I} as [the|my|your] [ID|tax ID|identity number|insurance number|social security number] [there|on the form|for now].
[The form asks for|Enter] the [ID|identity number|insurance number], [mine is|it is|so] {I}.
(ID no. {I}) [as noted|, checked|on the card].
[identity|id|ID|personal] [number|no.|card] [(|( ]{I})
[We moved|They moved|I moved] [to|into] {A}[ in {T}|, {T}| last year| with the cat].
[Home|Office|Postal|Billing|Delivery|Shipping|My] address: {A}[, {T}|, {Z} {T}|]
[Street|Residence|Pick-up point|Visit us|Location|Where]: {A}
[Residence|Warehouse|Location|Our address now|On file]: {A}
[Stay|Find us|Meet|We are|I work] at {A}
[Leave|Bring|Send|Post] [the box|the parcel|it|everything] [to|at] {A}[, {T}|, {Z} {T}|] [and ring twice|please|before noon|].
[We sit|Wait|Park|He works|The desk is] [on the top floor of|at the back of|in front of|in the yard of|opposite|on the first floor of] {A}.
[The shop|Our clinic|The workshop|The depot|A flat] [is|stands|sits|opens] [at|on|behind] {A}[.|, second floor.|, next to the bank.| in {T}.]
[Collect|Pick up|Fetch] [it|the chair] from {A} [on Monday|, side door|after work].
{A}, {T}
{N}, {A}, {Z} {T}
{N}\\n{A}\\n{Z} {T}
{N}, {P}, {E}
[Ask for|Speak to|Look for] {N} [on|at] {P} or [write to|mail] {E}.
""",
    "de": """
[Geben|Reichen|Bringen] Sie [das|den Ordner|die Schlüssel] [bitte|] {title} {N} [am Empfang|persönlich|im zweiten Stock].
[Hier spricht|Ich bin|Hier ist|Ich heiße|Das ist] {N}[.| aus dem Nordbüro.| vom Lager.]
{N} [hat angerufen|wohnt nebenan|holt es ab|zahlt mit Karte|bat um Geduld|schrieb den Bericht|war gestern hier].
[Gemalt|Geschrieben|Geprüft|Genehmigt|Verkauft|Das wurde gemacht] von {N} [im Mai|auf Papier|letzte Woche|].
[Ein Anruf|Der Brief|Die Klage|Eine Nachricht|Das Geschenk] [kam|war] von {N}.
{N} hat [das Rad repariert|den Brief geöffnet|bestellt|den Vertrag geprüft|die Lampe gekauft|es vergessen].
[Rufen|Suchen|Finden|Begrüßen|Grüßen|Sprechen] Sie [bitte|] [mit|] {title} {N}[.| an.| im Flur.]
[Der Anrufer|Meine Nachbarin|Der Käufer|Die Kundin] [war|ist|heißt] {N}.
[Viele Grüße|Herzliche Grüße|Beste Grüße|Hochachtungsvoll|Liebe Grüße|Ihr|Ihre]\\n{N}
[Name|Vor- und Nachname|Empfänger|Absender|Kunde|Ansprechpartner|z. Hd.]: {N}
[Wir|Sie] [trafen|sahen|fragten|riefen] {title} {N} [am Dienstag|gestern Abend|auf der Messe|im März][.| an.]
[Laut|Dank|Mit] {N} [ist alles gut|fehlt ein Teil|kamen wir an].
[Mail|E-Mail|Postfach|Antwort an|Schreibt an]: {E}
[Senden|Schicken|Mailen] Sie [es|die Datei|den Scan|alles] an {E} [bis Mittag|noch heute|].
[Meine|Die neue|Die alte] [Adresse im Netz|Mailadresse|Adresse] {E} [ist voll|gilt nicht mehr|funktioniert wieder].
[Die Rechnung|Jede Meldung] ging an {E} [aus Versehen|gestern|nicht an mich].
[Sie erreichen mich|Erreichbar bin ich|Wählen Sie|Probieren Sie es] [unter|unter der Nummer] {P} [ab neun Uhr|jederzeit|morgen|].
[Mobil|Handy|Fon|Fax|Rufnummer|Telefonnummer|Festnetz|Durchwahl]: {P}
[Mobil|Handy|Fon|Fax|Ruf|tel:|Tel-Nr.|Tel.-Nr.] {P}
[Deine|Seine|Ihre|Unsere] Nummer [lautet|ist] {P}.
[Die Nummer|Seine Nummer|Ihr Anschluss|Mein Handy] [ist|war|hat] {P}[.| ext. {d}.|, Durchwahl {d}.| oder so.]
[Fahrer|Gäste|Eltern] [können|sollen|dürfen] {P} [ext. {d}|] [anrufen|wählen|nutzen].
[Niemand hebt ab|Ich sprach aufs Band|Keiner geht ran] unter {P}.
[Steuernummer|Ausweis-Nr.|Versicherungsnummer|Personalausweis|Steuer-Identnummer|Identifikations-Nr.|Identnummer|ID-Nr.|Sozialversicherung|Passnummer|Personennummer]: {I}
[Deine|Ihre|Unsere] Identifikationsnummer [ist|lautet|heißt] {I}.
[Meine|Seine|Ihre|Die] [Steuernummer|Ausweisnummer|Versicherungsnummer|ID-Nummer|Personennummer|Identnummer] [ist|lautet|war] {I}[.| laut Karte.]
[Tragen Sie|Sie tragen] {I} als [Steuernummer|Ausweisnummer|Ident-Nummer] ein.
[Auf dem Antrag|Im Formular|Dort] steht [die Steuernummer|die Ausweisnummer|als Identnummer] {I}.
(Ausweis {I})
[Wir zogen|Sie zog|Ich ziehe] [in die|nach|zur] {A}[, {T}| um|, {Z} {T}].
[Anschrift|Wohnort|Rechnungsadresse|Adresse|Postanschrift|Lieferung an]: {A}[, {T}|, {Z} {T}|]
[Ich lebe|Wir leben jetzt|Er arbeitet|Sie wohnt|Wohnhaft] [in der|hier:|] {A}[, {Z} {T}|, {T}|][.|]
[Legen|Bringen|Stellen] Sie [das Paket|es|alles] [bitte|] [in die|zur|vor die] {A}[, {T}|, {Z} {T}|].
[Der Laden|Unsere Praxis|Die Werkstatt|Eine Wohnung|Das Lager] [ist|liegt|steht] [an der Ecke|gegenüber|jetzt]: {A}[.|, zweiter Stock.]
[Abholung|Treffpunkt] {A} [am Montag|, Seiteneingang|].
{A}, {Z} {T}
{N}, {A}, {Z} {T}
{N}\\n{A}\\n{Z} {T}
[Fragen Sie|Es hilft] {N} unter {P} oder {E}.
""",
    "fr": """
[Donnez|Remettez|Laissez] [ceci|les clés|le dossier] à {title} {N} [à son arrivée|en main propre|au deuxième étage].
[Ici|Je suis|C'est|Mon nom est|Nous attendons] {N}[.| du bureau nord.| et deux invités.]
{N} [a appelé deux fois|habite à côté|viendra le chercher|a payé par carte|a écrit le rapport|demande un délai].
[Peint|Écrit|Vérifié|Approuvé|Vendu] par {N} [en mai|sur papier|la semaine passée|].
[Le colis|La lettre|Un appel] [venait|vient] de {N}.
[Je cherche|Voyez|Consultez|Parlez à|Prévenez] {title} {N} [demain|au guichet|au besoin|].
{N} a [ouvert la lettre|réparé le vélo|acheté la lampe|commandé|oublié le sac|relu le contrat].
[Appelez|Trouvez|Suivez|Remerciez|Attendez|Invitez|Saluez|Cherchez] {title} {N} [à l'étage|dans le couloir|au plus vite|].
[La cliente|Mon voisin|L'acheteur|Le patient] [était|est|s'appelle] {N}.
[Demandez à voir|Passez voir|Remplacez|Réveillez|Aidez|Écoutez] {title} {N} [à midi|à côté|au fond|].
[Bien à vous|Amicalement|Salutations|Merci d'avance|Bien cordialement],\\n{N}
[Nom|Nom et prénom|Destinataire|Expéditeur|Client|À l'attention de] : {N}
[Nous avons|Elle a] [rencontré|vu|invité|remercié] {title} {N} [mardi|hier soir|au salon|en mars].
[Selon|Grâce à|Avec] {N}, [tout va bien|la pièce manque|on a trouvé].
[Courriel|Mail|E-mail|Répondre à|Boîte] : {E}
[Envoyez|Transmettez|Adressez] [le fichier|le tout|votre réponse|cela] à {E} [avant midi|ce soir|].
[Ma nouvelle adresse|L'ancienne boîte|Sa messagerie] {E} [est pleine|ne marche plus|fonctionne de nouveau].
[La facture|Chaque alerte] est partie à {E} [par erreur|hier|].
[Joignez|Contactez|Rappelez] [moi|nous|-moi|le bureau] au {P} [avant neuf heures|demain|quand vous voulez|].
[Portable|Mobile|Fax|Ligne directe|Numéro de téléphone|Fixe|Standard] : {P}
[Portable|Mobile|Fax|Ligne|tél|tel:|N° de tél.] {P}
[Ton|Son|Notre] numéro est le {P}.
[Le numéro|Son numéro|Sa ligne|Mon portable|Notre numéro|Ton numéro] [est|était] [le|] {P}[.|, poste {d}.| ext. {d}.]
[Les livreurs|Les parents] peuvent [appeler|faire|composer] le {P}.
[Personne ne répond|J'ai laissé un message|Ça sonne] au {P}.
[Numéro fiscal|Carte d'identité|Sécurité sociale|Passeport|Identifiant national|N° de sécu|Numéro d'assuré] : {I}
[Mon|Son|Le] [numéro fiscal|numéro d'assuré|numéro de carte d'identité|numéro d'identité|identifiant] [est|était] [le|] {I}.
[Inscrivez|Notez|Indiquez] {I} comme [numéro fiscal|numéro d'assuré|identifiant].
[Sur le formulaire|Au dossier], [numéro de sécurité sociale|carte d'identité] {I}.
(carte {I})
[Nous avons emménagé|Elle habite|Il loge|On se voit] [au|] {A}[, {T}| à {T}|, {Z} {T}].
[Domicile|Livraison|Facturation|Bureau|Adresse postale] : {A}[, {T}|, {Z} {T}|]
[Livraison|Dépôt|Venez|Rendez-vous|Apportez-le|Déposez-le] au {A}[, {T}|, {Z} {T}|][.|]
[Déposez|Apportez|Envoyez] [le colis|tout|la chaise] au {A}[, {T}|, {Z} {T}|] [s'il vous plaît|et sonnez|].
[La boutique|Notre cabinet|L'atelier|Le dépôt] [est|se trouve|ouvre] au {A}[.|, deuxième étage.| à {T}.]
[Retrait|Rendez-vous] : {A}
{A}, {Z} {T}
{N}, {A}, {Z} {T}
{N}\\n{A}\\n{Z} {T}
[Voyez avec|Demandez à parler à] {N} au {P} ou à {E}.
""",
    "es": """
[Dé|Entregue|Deje] [esto|las llaves|la carpeta] a {title} {N} [cuando llegue|en mano|en el segundo piso].
[Soy|Habla|Aquí está|Mi nombre es|Esperamos a] {N}[.| de la oficina norte.| y dos invitados.]
{N} [llamó dos veces|vive al lado|lo recogerá|pagó con tarjeta|escribió el informe|pide un plazo].
[Pintado|Escrito|Revisado|Aprobado|Vendido] por {N} [en mayo|en papel|la semana pasada|].
[El paquete|La carta|Una llamada] [venía|es] de {N}.
[Busco a|Vea a|Consulte a|Hable con|Avise a] {title} {N} [mañana|en ventanilla|si hace falta|].
{N} [abrió la carta|reparó la bici|compró la lámpara|olvidó el bolso|revisó el contrato|pidió dos sillas].
[Llame|Busque|Encuentre|Siga|Espere|Invite|Salude] a {title} {N} [en el pasillo|arriba|cuanto antes|].
[Vaya con|Trabaja para|Espere por|Firma por|Responde por] {title} {N}[.| hoy.]
[La clienta|Mi vecino|El comprador|La paciente] [era|es|se llama] {N}.
[Atentamente|Saludos cordiales|Muchas gracias|Cordialmente|Un abrazo],\\n{N}
[Nombre|Nombre y apellidos|Destinatario|Remitente|Cliente|A la atención de]: {N}
[Vimos|Conocimos|Invitamos|Llamamos] a {title} {N} [el martes|anoche|en la feria|en marzo].
[Según|Gracias a|Junto con] {N}, [todo va bien|falta la pieza|lo encontramos].
[Correo|Mail|E-mail|Responder a|Buzón]: {E}
[Mande|Reenvíe|Remita] [el archivo|todo|su respuesta|eso] a {E} [antes del mediodía|esta noche|].
[Mi nueva dirección|El buzón viejo|Su cuenta] {E} [está lleno|ya no vale|vuelve a funcionar].
[La factura|Cada aviso] fue a {E} [por error|ayer|].
[Marque|Contácteme en|Localícenos en|Pruebe] el {P} [antes de las nueve|mañana|cuando quiera|].
[Móvil|Celular|Fax|Número de teléfono|Fijo|Centralita]: {P}
[Móvil|Fax|Fijo|Tfno.|tel:|tel|Teléf.] {P}
[Tu|Su|Nuestro] número es el {P}.
[El número|Su número|La línea|Mi móvil|Nuestro número|Tu número] [es|era] [el|] {P}[.|, extensión {d}.| ext. {d}.]
[Los repartidores|Los padres] pueden [llamar|marcar|usar] el {P} [ext. {d}|].
[Nadie contesta|Dejé un recado|Suena] en el {P}.
[DNI|NIE|Seguridad social|Pasaporte|Número fiscal|Carné de identidad|N.º de identificación]: {I}
[Mi|Su|El] [número fiscal|DNI|número de afiliación|carné de identidad|número de identificación] [es|era] [el|] {I}.
[Ponga|Anote|Indique] {I} como [número fiscal|DNI|identificación].
[En el impreso|En la ficha] consta [el DNI|la identidad|el número] {I}.
(DNI {I})
[Nos mudamos a|Ella reside en|Se aloja en|Nos vemos en] {A}[, {T}| en {T}|, {Z} {T}].
[Domicilio|Entrega|Facturación|Oficina|Dirección postal]: {A}[, {T}|, {Z} {T}|]
[Entrega|Venga|Déjelo|Llévelo|Cita] [en|a] {A}[, {T}|, {Z} {T}|][.|]
[Deje|Lleve|Envíe] [el paquete|todo|la silla] [en|a] {A}[, {T}|, {Z} {T}|] [por favor|y llame|].
[La tienda|Nuestra consulta|El taller|El almacén] [está|se encuentra|abre] en {A}[.|, segunda planta.| de {T}.]
[Recogida|Cita] en {A}
{A}, {Z} {T}
{N}, {A}, {Z} {T}
{N}\\n{A}\\n{Z} {T}
[Hable con|Busque a] {N} en el {P} o en {E}.
""",
}

PLAIN = {
    "en": """
[The|A|Our|Your|This] [garden|printer|contract|window|engine|report|kitchen|meeting|bus|lamp] [needs|lost|shows|has|makes|gets] [a|the|some] [part|noise|date|light|colour|problem] [today|again|each week|after lunch|at night].
[We|They|I|You|Most people] [think|said|hope|know|wrote] that [the|this|your] [price|answer|road|colour|room|plan] [is|was|seems] [fine|wrong|too high|late|unclear|ready].
[Can|Could|Would|Will|Do] you [explain|check|shorten|translate|rewrite|list|sort] [this|the following|these] [lines|notes|numbers|paragraphs] [for me|into French|in plain words|by date]?
[Good|Short|Great|New|Fair] [idea|news|trip|answer|point][.|!]
[Pass|Take|Open|Close|Cut|Note|Ship] [the|a|some] [bag|door|bread|gas|list] [before|after|then] [noon|that|the rain].
[Turn|Put|Sort|Bill|Mark|Grant|Pat] [the list|it|them] [into a table|down as done|by hand|on the back|to the front].
[Will|May|Can] [the|this|our] [driver|box|order|train] [come|arrive|stop|wait] [at|after|near] [noon|the gate|the station]?
[It|This] [took|costs|weighs|lasts] {d} [minutes|euros|kilos|days|percent|pounds|metres] [in all|more than before|per year|at most].
[In|Since|Until|By] [March|April|May|June|August|October] {dddd} [we|they|prices] [rose|moved|waited|fell].
[The|A] {G} [Max|Ultra|Classic|Go|One|Air|Home] [heater|phone|desk|bike|mixer|speaker] [broke|arrived|is on sale|weighs {d} kilos|has {d} buttons].
[Walk|We ran|They camped|Turn left|Parking] [by|at|near|past|around|through|to] {G} [Hill|Lake|Square|Bridge|Market|Forest|Station|Tower|Gardens|Valley|Creek|Bay|Falls|Point|Beach|Castle|Harbour|Woods|Island|Park|Hall] [at {d}|for {d} hours|, exit {d}|before dark|in hall {d}].
[Buy|Order|Try|Charge|Return] [a|the|my] {G} [Max|Pro|Duo|Lite|Home|Twin] [kettle|heater|lamp|phone|chair] [today|for {d} dollars|in blue|].
[My|The] {G} [Pro|Duo|Lite|Twin|One|Air] [hums|leaks|stopped|needs ink] [after|within] {d} [days|hours].
[Open|Read|Join|Leave] [the|] {G} [Prize|Street Fair|Foundation|Award|Theatre|Fund] [page|list|hall|desk] [by|at] {d}.
[The|Our|A] {G} [Valley|Creek|Bay|Beach|Island|Forest|Hills|Lake] [tour|trail|map|school|hotel|bus] [starts|ends|opens] [at|in] {d}.
{"[city|stop|from|to|site|port]": "{T}", "[count|nights|seats|hours]": {d}}
{"[ok|done|open]": [true|false], "[name|title|label|kind]": "[report|draft|note|list]"}
[The|Our] [East|North|Old|Grand|Lower|Side] [Door|Wing|Hall|Pier|Tower|Entrance] [shuts|opens] [at|after|from] {d}[.| past noon.| each day.]
[See|Read|Compare|Look at] {x}[ for more.| and tell me.| before you start.]
{x} [was|has been|stays|seems] [paid|missing|lost|shipped|correct|wrong|unknown|fixed].
[Please|Now] [track|quote|use|install|reset|ignore|update|visit] {x} [first|today|if needed|and restart].
[Every|No|Each|Some] [Monday|Tuesday|Friday|Sunday|Christmas] [we|they] [bake|rest|meet|run] [in|at|near] [Town Hall|Room {d}|Hall {d}|Gate {d}|the Old Mill].
[North|South|East|West|Upper|Lower] [Side|Bank|Deck|Line|Ring] [is|was] [closed|busy|open] [today|until {d}].
[Windows|Linux|Python|Excel|Android|Chrome] [asks|fails|stops|opens] [after|with] [step|line|code] {d}.
[French|German|Spanish|English|Italian] [text|wine|grammar|lessons] [is|are|seems] [fine|hard|short].
[The|A] [parcel|label|screen|log|page|badge] [says|shows|carries|lists] {x}[.| in red.| twice.]
[Dear team|Hello|Hi there|Good morning|Thanks|Best regards|Regards|Yours|To whom it may concern],
[My|Her|His] [name|number|address|phone|email|tax form|ID card] [is not needed|was lost|stays private|changed|is on file].
[Call|Phone|Write to|Ask] [the office|support|a friend|the bank] [first|today|if it rains|before {d}].
[Act as|You are|You play] a [careful|short-spoken|kind|patient] [editor|tutor|clerk|reviewer|guide].
[Summarise|Describe|Explain] [how|why] [bees|clouds|bridges|locks|markets] [work|form|matter] [in|within] {d} [words|steps|lines].
[Which|What|How many] [tools|steps|mistakes|colours] [are common|matter most|do I need] [for|in|with] [brewing|sailing|pottery|first aid]?
def [area|half|total]([width|n|rows]):\\n    return [width|n|rows] * {d}
""",
    "de": """
[Der|Ein|Unser|Dieser] [Garten|Drucker|Vertrag|Motor|Bericht|Bus|Termin|Schrank] [braucht|zeigt|hat|macht|verliert] [ein|das|etwas] [Teil|Geräusch|Licht|Problem|Datum] [heute|schon wieder|jede Woche|nach dem Essen].
[Wir|Sie|Ich|Die meisten] [denken|sagten|hoffen|wissen|schrieben], dass [der Preis|die Antwort|das Zimmer|die Farbe|der Plan] [stimmt|zu hoch ist|falsch war|fertig ist].
[Können|Könnten|Würden] Sie [das|diese Zeilen|den Absatz] [kurz|bitte|noch einmal] [erklären|prüfen|kürzen|übersetzen|ordnen]?
[Es|Das] [dauerte|kostet|wiegt] {d} [Minuten|Euro|Kilo|Tage|Prozent|Meter] [insgesamt|mehr als sonst|im Jahr].
[Im|Seit|Bis] [März|April|Mai|Juni|August] {dddd} [stiegen die Preise|warten wir|war Ruhe].
[Der|Das] {G} [Max|Ultra|Klassik|Go] [Ofen|Rad|Handy|Tisch] [ist kaputt|kam an|wiegt {d} Kilo].
[Am|Beim|Hinter dem] {G} [See|Berg|Turm|Markt|Bahnhof] [war es still|gibt es {d} Bänke].
[Siehe|Prüfen Sie|Vergleichen Sie] {x}[.| vorher.]
{x} [ist|war|bleibt] [bezahlt|verloren|geschlossen|falsch|unbekannt].
[Das Etikett|Die Seite|Der Bildschirm] zeigt {x}.
[Guten Tag|Hallo|Liebes Team|Mit besten Wünschen|Danke],
[Mein|Ihr] [Name|Anschluss|Ausweis] [ist nicht nötig|bleibt geheim|ging verloren].
[Warum|Wie|Wann] [brauchen|bauen|nutzen] [Städte|Bienen|Schulen] [Wasser|Licht|Strom|Holz]?
[Die|Eine] [Lieferung|Rechnung|Heizung|Wohnung|Tür|Pumpe|Messung] [kam zu spät|ist offen|wird geprüft|steht im Keller|läuft wieder].
[Welche|Welcher|Diese|Jede|Manche|Solche|Unsere|Keine] [Farben|Werte|Fragen|Länder|Regeln|Wege|Preise] [sind|waren|gelten|helfen] [üblich|wichtig|frei|neu][, wenn es regnet|?|.]
[Unser|Der neue|Das] {G} [Plus-Paket|Tarif|Kalender|Modell|Platz|Park|Haus|Saal] [läuft aus|ist voll|kostet {d} Euro].
[Gute|Kurze|Neue|Alte|Kleine|Große|Schöne|Freie|Letzte] [Idee|Pause|Nachricht|Reise|Fahrt|Aussicht|Wahl|Antwort][.|!]
[Das|Dies] [ist|war] [eine|keine] [gute|kurze|neue] [Idee|Reise|Antwort].
[Vielen Dank|Besten Dank] für [die Hilfe|den Hinweis|Ihre Zeit].
""",
    "fr": """
[Le|Un|Notre|Ce] [jardin|contrat|moteur|rapport|train|placard] [a besoin d'|montre |perd |fait ][une pièce|un bruit|la lumière|un souci] [aujourd'hui|encore|chaque semaine].
[Nous|Ils|Je|On] [pensons|disent|crois|sait] que [le prix|la réponse|la chambre|le plan] [est juste|était faux|semble trop haut|est prêt].
[Pouvez-vous|Peux-tu|Veuillez] [expliquer|vérifier|raccourcir|traduire|trier] [ces lignes|le paragraphe|la liste] [pour moi|en clair|par date] ?
[Cela|Ça] [a pris|coûte|pèse|dure] {d} [minutes|euros|kilos|jours|mètres] [en tout|de plus|par an].
[En|Depuis|Avant] [mars|avril|mai|juin|août] {dddd} [les prix montent|on attend|tout va bien].
[Le|La] [{G} Max|{G} Ultra|{G} Classique|montre {G}] [est en panne|est arrivée|pèse {d} kilos].
[Quel|Quelle|Ces|Chaque|Nos|Aucun] [prix|règle|route|pays|valeur] [change|compte|suffit|aide] [ici|souvent|en été|] ?
[Le lac|Le parc|La salle|La tour|Le modèle|La gare|Notre offre] {G} [ferme|ouvre|coûte] [à|dès] {d} [heures|euros].
[Voir|Vérifiez|Comparez] {x}[.| avant tout.]
{x} [est|était|reste] [payé|perdu|fermé|faux|inconnu].
[L'étiquette|La page|L'écran] affiche {x}.
[Bonjour|Bonsoir|Chère équipe|Merci bien],
[Mon|Son] [nom|numéro|passeport] [n'est pas utile|reste privé|est perdu].
[Bonne|Belle|Grande|Petite] [idée|nouvelle|route|réponse|journée][.| !]
[Passez|Prenez|Posez|Ouvrez|Fermez|Coupez|Notez] [le|au|la] [sac|porte|pain|gaz|courant] [avant|après|puis] [midi|cela|la pluie].
[Pourquoi|Comment|Quand] [les villes|les abeilles|les écoles] [ont-elles besoin d'eau|travaillent|changent] ?
[La|Une] [livraison|facture|chaudière|porte|pompe|mesure] [est en retard|est ouverte|sera vérifiée|marche encore].
""",
    "es": """
[El|Un|Nuestro|Este] [jardín|contrato|motor|informe|tren|armario] [necesita|muestra|pierde|hace] [una pieza|un ruido|la luz|un problema] [hoy|otra vez|cada semana].
[Nosotros|Ellos|Yo|Muchos] [pensamos|dicen|creo|saben] que [el precio|la respuesta|la sala|el plan] [es justo|era falso|parece alto|está listo].
[¿Puede|¿Podría|¿Quiere] [explicar|revisar|acortar|traducir|ordenar] [estas líneas|el párrafo|la lista] [por fecha|con calma|]?
[Esto|Eso] [tardó|cuesta|pesa|dura] {d} [minutos|euros|kilos|días|metros] [en total|más|al año].
[En|Desde|Hasta] [marzo|abril|mayo|junio|agosto] {dddd} [suben los precios|esperamos|todo fue bien].
[El|La] {G} [Max|Ultra|Clásico] [está roto|llegó ayer|pesa {d} kilos].
[Qué|Cuál|Estos|Cada|Nuestros|Ningún] [precio|regla|camino|país|valor] [cambia|cuenta|basta|ayuda] [aquí|siempre|en verano|].
[El lago|El parque|La sala|La torre|El modelo|La estación|La oferta] {G} [cierra|abre|cuesta] [a|desde] {d} [horas|euros].
[Véase|Revise|Compare] {x}[.| antes.]
{x} [está|estaba|queda] [pagado|perdido|cerrado|mal].
[La etiqueta|La página|La pantalla] muestra {x}.
[Hola|Buenos días|Estimado equipo|Mil gracias],
[Mi|Su] [nombre|número|pasaporte] [no hace falta|es privado|se perdió].
[Buena|Gran|Nueva|Corta] [idea|noticia|ruta|respuesta|jugada][.|.]
[Pase|Tome|Ponga|Abra|Cierre|Corte|Anote|Mándeme] [el|la|al] [bolso|puerta|pan|gas|recado] [antes|después|luego].
[¿Por qué|¿Cómo|¿Cuándo] [necesitan agua las ciudades|trabajan las abejas|cambian las escuelas]?
[La|Una] [entrega|factura|caldera|puerta|bomba|medida] [llega tarde|está abierta|se revisará|funciona].
""",
}

#: Numbers and handles that are no personal data, as patterns: # digit, & letter, @@ a sign, % hexadecimal digit.
LOOKALIKES = """
order ####-####
order number #####
purchase ###-###
case no. ######
ticket no. #######
claim #### of ####
invoice &&-####-#####
INVOICE ####/####
bill &&&-######
booking &&&###
parcel &&#########&&
tracking number ################
serial number ####-###-##
serial no. ####/###/##
serial ####/##/###
SN ###/####/##
article ###/###/##
part no. ##/####/###
series ####/###, row ##
lot ####, shelf ##
part &&-#### rev. #
model &##-###
version ##.#.##
release #.#.#-beta
chapter #.##.#
paragraph ##.##.##
clause ## (#)
page ### of ###
hash %%%%%%%%%%%%
commit %%%%%%%
checksum %%%%%%%%%%%%%%%%
###### x #### x ### mm
#### x ## cm
### by ### by ## inches
##:##:##
##:## on ##/##/####
##.##.####
####-##-##
€ ##.##
#,###.## dollars
$####
10.#.##.###
192.168.#.##
@@&&&&_####
@@&&&&&&&
&&&&-&&&&@@#.#.#
&&&@@##.#
#&&&&&&&
https://www.&&&&&&.org/####
http://&&&&&.net/&&&&/##
&&&&&.txt
flight && ####
room ###
gate &##
bus ##
ISBN 978-#-####-####-#
seat ##&
call_#########
id_######
task ########
account ending in ####
batch ########
counter #########
""".strip().split("\n")

TITLES = {"en": "Mr,Mrs,Ms,Dr,Miss,Prof.,Mr.,Mrs.,Sir", "de": "Herrn,Frau,Dr.,Herrn Dr.,Prof.,Herr", "fr": "M.,Mme,Mlle,Dr,Monsieur,Madame,Me", "es": "Sr.,Sra.,D.,D.,Dña.,Dr.,Dra.,Don,Doña"}
GIVEN = (
    "Alice,Oliver,Emma,Noah,Sophie,Liam,Charlotte,James,Emily,Henry,Lucy,Daniel,Megan,Simon,Hannah,Lukas,Lena,Felix,Paula,Moritz,Katrin,Uwe,Heike,Sabine,Günter,Mathieu,Camille,Théo,Manon,Luc,Élodie,Benoît,"
    "Céline,Javier,Lucía,Pablo,Marta,Álvaro,Beatriz,Íñigo,Rocío,Giulia,Marco,Paolo,Chiara,Aylin,Mehmet,Fatima,Omar,Yuki,Chen,Wei,Anjali,Arjun,Ngozi,Kwame,Ewa,Jakub,Björn,Astrid,Sven,Ingrid,"
    "Joy,Summer,April,June,May,Art,Bob,Chase,Pat,Sky,Ivy,Lily,Violet,Ruby,Amber,Jack,Max,Drew,Rob,Sue,Dean,Page,Gene"
)
FIRST_SYLLABLES = "Ad,Ber,Bran,Cal,Chad,Cor,Dal,Dren,El,Fal,Fen,Gar,Gol,Hart,Hel,Ing,Jar,Kar,Kil,Lam,Lor,Mal,Mar,Mil,Nar,Nel,Os,Par,Pel,Quin,Ral,Ros,Sal,Ser,Stan,Tal,Tren,Ul,Val,Ver,Wal,Wil,Yar,Zan"
MIDDLE_SYLLABLES = ",,,a,e,i,o,en,er,is,un,am,or"
LAST_SYLLABLES = "ton,ley,ford,son,wood,er,stein,bach,feld,mayer,hofer,eau,ier,oux,ard,on,ez,ado,ero,illa,ini,aro,ucci,ic,owski,dottir,sen,quist,ath,ell,ing,worth,by,as,us,ik,man,lin,dal,mere"
STREET_WORDS = {
    "en": "Oak,Mill,Church,High,Park,Bridge,Queen,Market,North,Spring,Garden,River,London,Orchard,Abbey,Kingsway,Chapel",
    "de": "Haupt,Bahnhof,Schul,Garten,Berg,Wald,Kirch,Linden,Ring,Markt,Mühlen,Goethe,Rosen,Wiesen",
    "fr": "Église,Gare,République,Moulin,Fontaine,Lilas,Victor Hugo,Paix,Pont,Marché,Écoles,Château",
    "es": "Mayor,Sol,Fuente,Iglesia,Constitución,Rosario,Molino,Paz,San Juan,Carmen,Norte,Luna",
}
TOWNS = "Leeds,Bristol,York,Exeter,Boston,Denver,Dresden,Kassel,Mainz,Ulm,Bremen,Graz,Lyon,Rennes,Nantes,Dijon,Lille,Sevilla,Murcia,Burgos,Vigo,Toledo,Utrecht,Turin,Porto"
HOSTS = "posteo.de,webmail.co.uk,orange.fr,correo.es,company.io,uni-kiel.de,web.de,proton.me,acme-tools.com,city.gov,school.edu,team.example,box.example.com,a.test,lab.invalid,verlag.at,north-shop.eu"
SIZES = ("d", "dd", "ddd", "dddd")


def _pick(random_: random.Random, text: str) -> str:
    return random_.choice(text.split(","))


def _word(r: random.Random) -> str:
    return _pick(r, FIRST_SYLLABLES) + _pick(r, MIDDLE_SYLLABLES) + _pick(r, LAST_SYLLABLES)


def _family(r: random.Random) -> str:
    word = _word(r)
    kind = r.random()
    return f"{_pick(r, 'van,de,von,da,Mc,O’,di,le')}{' ' if kind < 0.03 else ''}{word}" if kind < 0.035 else f"{word}-{_word(r)}" if kind < 0.12 else word


def _given(r: random.Random) -> str:
    # names that no list holds are names all the same
    return _pick(r, GIVEN) if r.random() < 0.85 else _word(r)


def _name(r: random.Random, titled: bool) -> str:
    given, family = _given(r), _family(r)
    kind = r.random()
    if titled and kind < 0.4:
        out = family if kind < 0.2 else f"{family}, {given}"
    elif kind < 0.08:
        out = f"{given} {family[0]}."
    elif kind < 0.18:
        out = f"{given} {r.choice('ABCDEFGHJKLMNPRSTVW')}. {family}"
    elif kind < 0.30:
        out = f"{family}, {given}" + (f" {r.choice('ABCDEGHJKLM')}." if r.random() < 0.2 else "")
    elif kind < 0.38:
        out = f"{given[0]}. {family}"
    elif kind < 0.41:
        out = f"{given} {_pick(r, GIVEN)} {family}"
    elif kind < 0.44:
        out = f"{given}-{_pick(r, GIVEN)} {family}"
    else:
        out = f"{given} {family}"
    return out.upper() if r.random() < 0.14 else out


def _plain_letters(text: str) -> str:
    return re.sub(r"[^a-z]", "", text.lower().translate(str.maketrans("áéíóúüöäëèçøéñîôï", "aeiouuoaeeecoenioi"[:17])))


def _email(r: random.Random) -> str:
    given, family = _plain_letters(_given(r)), _plain_letters(_word(r))
    n = r.randint(0, 99)
    own = r.choice([f"{given}.{family}", f"{given}_{family}", f"{given[0]}{family}", f"{family}{n}", f"{family}-{given}", f"{family}+{r.choice(['news', 'shop', 'box'])}{n}", family, f"{given}.{family[0]}.{family}", f"{given}{n}", f"{family}.{given}+tag", r.choice(["info", "sales", "office", "hr"])])
    host = _pick(r, HOSTS) if r.random() < 0.5 else f"{_plain_letters(_word(r))}.{r.choice(['com', 'example', 'de', 'fr', 'es', 'net', 'org', 'test', 'co.uk', 'invalid'])}"
    out = r.choice([f"{own}@{host}"] * 6 + [f"{own} [at] {host}", f"{own} @ {host}", f"{own} (at) {host}", f"{own} (at) {host.replace('.', ' (dot) ')}", f"{own}[at]{host}", f"{own} [at] {host.replace('.', ' [dot] ')}"])
    return out.upper() if r.random() < 0.12 else out


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _grouped(r: random.Random, n: int, sep: str) -> str:
    """n digits in groups of two to four, or in one piece where there is no sign between groups."""
    if not sep:
        return _digits(r, n)
    size = r.choice((2, 3, 3, 4))
    sizes = []
    while n > 0:
        take = n if n <= size + 1 else size
        sizes.append(take)
        n -= take
        size = r.choice((size, size, 2, 3, 4))
    return sep.join(_digits(r, k) for k in sizes)


def _phone(r: random.Random) -> str:
    kind = r.random()
    if kind < 0.35:  # ten digits in 3-3-4
        a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
        out = r.choice([f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}{b}{c}", f"{a}{b}{c}", f"({a}) {b} {c}"])
        if out.isdigit():
            return r.choice(["", "1", "1", "+1"]) + out
        return r.choice(["", "", "", "+1-", "+1 ", "1-"]) + out if out[0] != "(" else r.choice(["", "", "+1 "]) + out
    sep = r.choice([" ", " ", " ", "", "-", ".", "/"])
    rest = r.randint(6, 9)
    if kind < 0.65:  # with country code
        lead = r.choice(["+44", "+49", "+33", "+34", "+39", "+31", "+41", "+48", "0044", "0049"])
        area = r.choice(["", "(0)", "(0) "]) + _digits(r, r.randint(1, 4)).replace("0", "3", 1)
        return f"{lead}{r.choice([' ', ' ', '', '-'])}{area}{r.choice([' ', '-', '/']) if sep not in ('', '.') else sep}{_grouped(r, rest, sep if sep != '/' else ' ')}"
    if kind < 0.8:  # pairs of digits
        return r.choice([" ", ".", "-", " "]).join([r.choice("06789") + _digits(r, 1), *[_digits(r, 2) for _ in range(4)]])
    area = "0" + _digits(r, r.randint(2, 4))
    if kind < 0.9:  # a trunk code and one or two pieces
        return "0" + r.choice([_digits(r, 4) + " " + _digits(r, 6), _digits(r, 10), _digits(r, 4) + " " + _digits(r, 3) + " " + _digits(r, 3), _digits(r, 9), _digits(r, r.randint(2, 4)) + r.choice("/ -/ ") + _digits(r, r.randint(5, 8))])
    if kind > 0.98:
        area = f"({area})"
    joint = r.choice([" ", "/", "-", " ", ""]) if area[0] != "(" else " "
    return f"{area}{joint}{_grouped(r, rest, sep if sep not in ('/', '.') else r.choice(['', ' ']))}"


IDENTITIES = """
###-##-####
### ## ####
###.##.####
#########
&& ## ## ## ^
&&-##-##-##-^
&&######^
&&######^
## ### ### ###
## ### ### ###
##-###-###-###
###########
###########
0##########
! ## ## ## ### ### ##
!##############
! ## ## ## ### ###
########^
##.###.###-^
X#######^
########-^
&########
&&#######
"""


def _fill_pattern(r: random.Random, pattern: str, identity: bool = False) -> str:
    pools = {"#": "0123456789", "&": "ABCEGHJKLMNOPQRSTWXYZ", "^": "ABCDEFGHJKLMNPQRSTVWXYZ", "!": "12", "%": "23456789" if identity else "0123456789abcdef"}
    return "".join(r.choice(pools[c]) if c in pools else c for c in pattern.replace("@@", "\0")).replace("\0", "@")


def _identity(r: random.Random) -> str:
    out = _fill_pattern(r, r.choice(IDENTITIES.strip().split("\n")), identity=True)
    return r.choice([out.lower(), re.sub("[A-Z]{2}", lambda m: m[0].lower(), out)]) if r.random() < 0.25 else out


def _lookalike(r: random.Random) -> str:
    pattern = r.choice(LOOKALIKES)
    letters = any(m in pattern for m in ("@@", "http", ".txt", "#&&&"))
    out = _fill_pattern(r, pattern)
    if letters:
        out = out.lower()
    return out[0].upper() + out[1:] if r.random() < 0.4 else out


def _address(r: random.Random, lang: str) -> str:
    word = _pick(r, STREET_WORDS[lang]) if r.random() < 0.4 else _word(r)
    other = _word(r)
    no = str(r.randint(1, 250)) + r.choice(["", "", "", "", "a", "b", "A", "c"])
    if lang == "en":
        kind = _pick(r, "Street,St,St.,Road,Rd,Rd.,Avenue,Ave,Ave.,Lane,Ln,Close,Terrace,Blvd,Boulevard,Drive,Dr,Court,Ct,Way,Place,Square,Crescent,Row,Hill")
        base = f"{no} {r.choice(['', '', '', 'Old ', 'New ', 'East ', 'Lower ', 'St. ', 'Upper '])}{word} {r.choice(['', '', '', '', 'Hill ', 'Park ', other + ' '])}{kind}"
        unit = f"{r.choice(['Flat', 'Apt', 'Apt.', 'Unit', 'Suite', 'Apartment', '#'])} {r.randint(1, 40)}{r.choice(['', '', 'A', 'B', 'C', 'D'])}".replace("# ", "#")
        return r.choice([base] * 5 + [f"{unit}, {base}"] * 2 + [f"{base}, {unit}"] * 2 + [f"{base}, {unit}"] * 2 + ([f"{base} {unit}"] if r.random() < 0.4 else []))
    if lang == "de":
        end = _pick(r, "straße,str.,str.,weg,gasse,allee,platz,ring,damm,ufer,strasse,steig")
        joined = r.choice([f"{word}{end}", f"{word}{end}", f"{word}er {end.capitalize()}", f"{word}-{other}-{end.capitalize()}", f"{r.choice(['Alte', 'Neue', 'Lange', 'Große'])} {word}{end}", f"{r.choice(['Am', 'Zum', 'Im', 'An der'])} {word}"])
        return f"{joined} {no}"
    if lang == "fr":
        kind = _pick(r, "rue,avenue,av.,place,chemin,boulevard,bd,allée,impasse,quai,Rue,Avenue,route,cours")
        link = r.choice(["", "de la ", "du ", "des ", "de l'", "de ", "du Vieux ", "Saint-", "du Général ", "des Petits "])
        tail = r.choice(["", "", "", "s", f" {other}"])
        return f"{r.randint(1, 250)}{r.choice([' ', ' ', ', ', ' bis ', ' ter '])}{kind} {link}{word}{tail}"
    kind = _pick(r, "Calle,C/,Avenida,Avda.,Av.,Plaza,Paseo,Camino,Ronda,calle,Travesía")
    link = r.choice(["", "", "de ", "de la ", "del ", "de los ", "de las ", "Virgen de ", "Doctor "])
    floor = r.choice(["", "", "", ", 3 B", ", bajo", ", 2º A", ", 1.º izq.", " 4 C", ", piso 2", ", bajo C"])
    return f"{kind} {link}{word}{r.choice(['', '', 'es', ' ' + other, ' de ' + other])}{r.choice([' ', ' ', ', ', ', n.º '])}{r.randint(1, 250)}{floor}"


def _choose(r: random.Random, frame: str) -> str:
    return re.sub(r"\[([^\[\]]*)\]", lambda m: r.choice(m[1].split("|")), frame)


def _strange(r: random.Random, piece: str) -> str:
    """Part of the plain words replaced by made-up ones of the same shape, as a text in the wild has words no table holds."""

    def put(m: re.Match) -> str:
        if len(m[0]) < 4 or r.random() > 0.12:
            return m[0]
        word = _word(r).lower() if m[0].islower() else _word(r) if m[0].istitle() else m[0]
        return word

    return re.sub(r"[^\W\d_]+", put, piece)


def _fill(r: random.Random, frame: str, lang: str, strange: bool) -> list[tuple[str, str]]:
    """(text, type or '') pieces of one sentence."""
    out: list[tuple[str, str]] = []
    titled = "{title} {N}" in frame
    for piece in re.split(r"(\{\w+\})", re.sub(r" +", " ", _choose(r, frame)).strip().replace("\\n", "\n")):
        slot = piece[1:-1] if re.fullmatch(r"\{\w+\}", piece) else None
        if slot is None:
            out.append((_strange(r, piece) if strange else piece, ""))
        elif slot in SLOT_TYPES:
            # numbers and names travel: a German text may hold a British phone number
            text = {"E": _email, "P": _phone, "I": _identity, "A": lambda q: _address(q, lang if q.random() < 0.85 else q.choice(list(FRAMES))), "N": lambda q: _name(q, titled)}[slot](r)
            out.append((text, SLOT_TYPES[slot]))
        else:
            plain = {"title": lambda: _pick(r, TITLES[lang]), "G": lambda: _pick(r, GIVEN), "T": lambda: _pick(r, TOWNS) if r.random() < 0.5 else _word(r), "Z": lambda: _digits(r, r.choice((4, 5, 5))), "x": lambda: _lookalike(r)}
            out.append((plain[slot]() if slot in plain else (str(r.randint(1, 60)) if slot == "d" else _digits(r, len(slot))), ""))
    return out


def frames(part: str, fold: tuple[int, int] | None = None) -> dict[str, list[str]]:
    """The frames by language; fold (i, n) keeps every n-th from i on, (-i - 1, n) all others."""
    out = {}
    for lang, text in (FRAMES if part == "personal" else PLAIN).items():
        own = text.strip().split("\n")
        if fold:
            i, n = fold
            own = [f for j, f in enumerate(own) if (j % n == i if i >= 0 else j % n != -i - 1)]
        out[lang] = own
    return out


def labelled_table(copies: int = 44, seed: int = 11, fold: tuple[int, int] | None = None, strange: bool = True) -> list[list[tuple[str, str]]]:
    """Texts as lists of (piece, type): every frame ``copies`` times, strung together with plain sentences around."""
    r = random.Random(seed)
    texts = []
    personal_of, plain_of = frames("personal", fold), frames("plain", fold)
    for _ in range(copies):
        for lang, own in personal_of.items():
            plain = plain_of[lang] + (plain_of["en"] if r.random() < 0.4 else [])
            personal = own + [f for f in own if "{I}" in f or "{A}" in f or "{P}" in f]
            r.shuffle(personal)
            while personal:
                pieces: list[tuple[str, str]] = []
                joint = r.choice([" ", " ", "\n"])
                n = r.randint(1, 3)
                here = personal[:n] + [r.choice(plain) for _ in range(r.randint(0, 4))]
                personal = personal[n:]
                r.shuffle(here)
                for frame in here:
                    if pieces:
                        pieces.append((joint, ""))
                    pieces += _fill(r, frame, lang, strange)
                texts.append(pieces)
        for lang, plain in plain_of.items():
            for frame in plain:
                texts.append(_fill(r, frame, lang, strange))
    return texts
