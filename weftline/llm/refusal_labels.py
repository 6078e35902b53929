"""The small labelled table that tells refusals from courtesies and from anything else.

Each line is a frame of one clause; braces hold alternatives, ``_`` stands for words the clause shares with its
question. A seeded generator draws from every frame. The table only says what declining sounds like in general; which
templates of a corpus are refusals comes from their recurrence.
"""

from __future__ import annotations

import random
import re

FRAMES = {
    "refusal": """
i {can't|cannot|can not|could not|won't|will not|am unable to|am not able to|'m unable to|'m not able to|shall not} {help|assist|support} {with this|you with this|you with that|with _|you there|on this one|here|with such a request|with requests like this}
i {can't|cannot|can not|won't|will not|am unable to|am not able to|'m not able to} {answer|discuss|address|respond to|comment on|talk about|go into|speak about|engage with|fulfil|fulfill|carry out|process|complete|take on} {that|this|it|this question|this request|your request|such requests|_|this topic|that subject|this matter|questions about _}
i {can't|cannot|won't|will not|am unable to|am not able to} {provide|give|offer|share|supply} {you with this|an answer|an answer to that|any information on this|details on that|information about _|guidance on _|advice on _|help with _|instructions for _}
i {can't|cannot|won't|will not|am unable to|am not able to} {help|assist} with {that matter|that one|your request|your question|it|that sort of request}
i {can't|cannot|won't|will not} {do|say|answer|comply with} {this|that|so|it|any of that}
i {must|have to|need to|will have to|would have to} {decline|refuse|pass|say no} {|this request|to answer|to answer that|to help|to help with _|to discuss _|here|on this one}
i {respectfully|politely|regretfully} decline {|to answer|this request|to comment|to talk about _}
i {decline|refuse} to {answer|discuss|help with|talk about|comment on|take part in} {that|this|_|your request}
i {'d|would} rather not {answer this|discuss this|talk about _|say|comment|speak about that|help with this|go there|deal with _}
i {'d|would} prefer not to {answer this|discuss this|talk about _|say|comment|speak about that|help with this}
i {prefer|choose} not to {answer this|discuss _|comment|speak about that|go into this}
i {am|'m} not {allowed|permitted|authorised|authorized|supposed|in a position|willing|going|prepared|able} to {answer that|discuss _|help with this|talk about this|comment|say anything about that|do this}
i {am|'m} not comfortable {answering that|discussing _|helping with this|with this request}
{that|this} is {a topic|a question|a subject|a request|a matter|one thing} {i|that i} {can't|cannot|won't|am not able to|must not|may not} {help with|answer|discuss|touch|deal with|comment on|go into}
{that|this|your|the} {request|question|topic} {goes against|violates|conflicts with|is against|is outside|falls outside|breaks} {my|our|the} {guidelines|rules|policy|policies|principles|limits|scope}
{answering|helping with|discussing} {this|that|_} {would go against|would violate|is against|conflicts with} my {guidelines|rules|policy|principles}
my {guidelines|rules|instructions|policies|settings} {do not|don't} {allow|permit} {me to answer|me to help|this|that|me to discuss _|answers on _}
it {would not be|wouldn't be|isn't|is not} {appropriate|right|proper|responsible} for me to {answer|discuss _|help with that|comment|go into this}
{that|this} {is not|isn't} {a subject|a topic|a question} {i am willing to|i want to|i can|i am free to} {go into|open up|discuss|take up|answer}
i {turn|have to turn|must turn} {this|that|this request|the question} down
no comment {|on this|on _}
there is nothing i can {say|tell you|do for you} {about that|here|on this|about _}
as an {assistant|artificial assistant|automated system} i {can't|cannot|may not|must not} {answer this|talk about _|help with such things|give advice on _}
this is {not a thing i do|outside what i can do|beyond what i may answer|nothing i may talk about|nothing i can help with}
{request|question} {denied|refused|declined|rejected}
{unable|not able} to {comply|help|answer|respond|assist} {|with this|with this request}
cannot {comply|help|answer|respond} {|with this|to this request}
you will not get {an answer|help} from me {on this|with _|here}
i {keep out of|stay away from|do not touch|don't discuss|do not answer|don't answer|do not comment on|don't give advice on} {this subject|such questions|_|matters like that|topics like this}
{hierbei|da|dazu|damit|hier} {kann|darf|möchte|werde|will} ich {leider nicht|nicht|dir nicht|ihnen nicht|euch nicht} {weiterhelfen|behilflich sein|dienen|antworten|unterstützen|aushelfen}
{ich kann|ich darf|ich möchte|ich werde|ich will} {|leider} {diese frage|das|dies|diese anfrage|dazu|darauf|auf _|hierzu|ihnen|dir|zu _} nicht {beantworten|bearbeiten|erfüllen|besprechen|behandeln|ausführen|weiterhelfen|antworten|kommentieren|erklären}
{das|diese anfrage|diese bitte|diesen wunsch|eine antwort} {muss|möchte|werde} ich {leider|hier|an dieser stelle|} {ablehnen|zurückweisen|verweigern|ausschlagen}
ich {muss|möchte} {leider|hier|} {passen|ablehnen|absagen|nein sagen}
ich lehne {das|es|diese anfrage|eine antwort|diese bitte} ab
{zu|über} _ {kann|darf|möchte|will|werde} ich {nichts|keine angaben|keine auskünfte} {sagen|machen|erteilen|geben}
{dazu|hierzu|darüber} {kann|darf|möchte|will} ich {nichts|mich nicht|keine angaben} {sagen|äußern|machen}
dazu {gebe ich keine auskünfte|sage ich nichts|gebe ich keine antwort|schweige ich}
{das|diese anfrage|die frage|so etwas} {verstößt gegen|widerspricht|passt nicht zu|liegt außerhalb von} {meine vorgaben|meinen vorgaben|meinen grundsätzen|die regeln|unsere richtlinien}
{meine vorgaben|meine richtlinien|die regeln} {erlauben|gestatten} {mir das nicht|keine antwort|das nicht|mir keine hilfe dabei}
es ist mir nicht {erlaubt|gestattet|möglich} {zu antworten|darüber zu sprechen|dabei zu helfen|auf _ einzugehen|das zu beantworten}
ich bin nicht {befugt|berechtigt|in der lage|bereit} {dazu|zu antworten|das zu beantworten|darüber zu sprechen|dabei zu helfen}
{darüber|über _} {spreche|rede|schreibe} ich {nicht|lieber nicht}
{darauf|auf _|hierauf} {gehe|antworte} ich {nicht ein|lieber nicht|nicht}
{bei diesem thema|in dieser sache|bei _} {helfe ich nicht|halte ich mich heraus|bin ich keine hilfe}
je {ne peux|ne puis|ne pourrai|ne vais|ne souhaite|ne veux|ne dois} pas {vous aider|t'aider|répondre|aider|en parler|donner suite|traiter cette demande|traiter ce sujet|aborder ce sujet|aborder _|discuter de _|commenter _|fournir ces informations|faire cela|m'exprimer sur _|répondre à _}
je {ne peux|ne puis|ne saurais} {rien dire|rien faire|rien vous dire} {à ce sujet|sur _|ici|là dessus}
je {dois|suis obligé de|suis contraint de|me vois obligé de} {décliner|refuser|renoncer|dire non} {|cette demande|de répondre|d'aider|la demande|de parler de _}
je {refuse|décline|rejette} {|cette demande|de répondre|de parler de _|de traiter ce sujet|votre demande}
je {préfère|préférerais|choisis de} ne pas {répondre à cela|aborder ce sujet|en discuter|parler de _|me prononcer}
je {n'ai pas le droit|n'ai pas la permission|ne suis pas habilité|ne suis pas autorisé|ne suis pas en mesure|ne suis pas capable} {de répondre|à répondre|d'en parler|à en parler|de vous aider|de traiter _|à traiter cette demande}
je ne {donnerai pas|fournirai pas|traiterai pas|commenterai pas|discuterai pas|parlerai pas} {de réponse|d'aide|cette demande|ce sujet|de _|de cela}
{il ne m'est pas permis|il m'est interdit|il m'est impossible} {de répondre|d'en parler|de traiter ce sujet|d'aider|de parler de _}
{cette demande|cette question|ce sujet|cela} {va contre|enfreint|viole|sort de|dépasse} {mes règles|mon cadre|mes limites|mes consignes|les règles}
{mes règles|mes consignes|mes principes} {m'interdisent|ne me permettent pas} {de répondre|d'aider|cela|d'en parler}
{pas de commentaire|aucun commentaire} {|sur _|à ce sujet}
{ce n'est pas un sujet|ce n'est pas une chose|ce n'est pas une question} {que je traite|dont je parle|à laquelle je réponds}
{no puedo|no podré|no voy a|no quiero|no debo|no deseo} {ayudar|ayudarle|ayudarte|ayudarle en esto|responder|contestar|responder a esa pregunta|responder a _|hablar de _|hablar de ello|tratar ese tema|comentar eso|atender esa petición|dar esa información|ofrecer consejos sobre _|hacer tal cosa}
{no puedo|no podré|no voy a|no quiero} {ayudar|ayudarle|ayudarte|ayudaros|asistirle} {en esto|con ello|en ese asunto|con ese asunto|con tu pregunta|con _}
{no me es posible|me es imposible|no me corresponde} {responder|contestar|ayudar|hablar de _|dar esa información|atender esa petición}
{debo|tengo que|he de|me veo obligado a} {rechazar|declinar|decir que no|negarme a} {|esta petición|la solicitud|responder|hablar de _|esa pregunta}
{rechazo|declino|me niego a} {esta petición|responder|hablar de _|esa solicitud|contestar|comentar _}
{prefiero|preferiría|elijo} no {responder|hablar de eso|hablar de _|entrar en ese tema|opinar|comentar nada}
no {tengo permiso|estoy en condiciones|estoy capacitado|tengo autorización} {para responder|de responder|para hablar de _|para ayudar|para ello}
{no se me permite|tengo prohibido|me está prohibido|mis reglas no permiten|mis pautas no permiten} {responder|hablar de _|ayudar con esto|eso|tratar ese asunto}
{esa petición|esa pregunta|esto|ese tema} {va contra|incumple|infringe|queda fuera de|se sale de} {mis reglas|mis pautas|mis principios|mis límites|las normas}
{sobre eso|sobre _|de eso|de ese tema} {no hablo|no opino|no puedo decir nada|no doy información|no contesto}
{sin comentarios|ningún comentario} {|sobre _|al respecto}
{non posso|non potrò|non voglio|non sono in grado di|devo rifiutarmi di|preferisco non} {aiutare|rispondere|parlarne|parlare di _|rispondere a questa domanda|soddisfare la richiesta}
{não posso|não vou|não consigo|devo recusar|tenho de recusar|prefiro não} {ajudar|responder|falar sobre isso|falar de _|o pedido|responder a isso}
{daar kan ik|hier kan ik|ik kan|ik mag|ik wil} {je niet mee helpen|niet op antwoorden|daar niet over praten|niet helpen met _|die vraag niet beantwoorden|hierbij niet helpen}
""",
    "courtesy": """
i {am|'m} {sorry|very sorry|really sorry|terribly sorry|afraid|so sorry}
{sorry|apologies|my apologies|i apologise|i apologize|my regrets|pardon me|unfortunately|regrettably}
{sorry|apologies} {about|for} {that|this|the inconvenience|the trouble|any inconvenience}
i hope {you understand|that is understandable|you can understand this|you see why}
{thank you|thanks} for {your understanding|understanding|asking|your patience|your question|reaching out|your interest}
{please|feel free to} ask {me|} {about something else|another question|something different|a different question}
is there {anything else|another thing} i can {do|help with|help you with|do for you}
i {would be|'d be|am} {happy|glad|pleased} to {help|assist} with {something else|another topic|other questions|any other question|a different subject}
let me know if {there is something else|you have another question|i can help with anything else|you need something different}
please {contact|consult|ask|talk to|turn to} {a professional|an expert|a specialist|somebody qualified|the right office}
you {may want to|could|might|should} {ask|contact|consult} {an expert|a specialist|a professional}
i {understand|see} {your interest|that this is disappointing|why you ask|this may be frustrating}
i know this is not {what you hoped for|the reply you wanted}
{do you have|would you like to ask|may i take} {another question|a different question|something else}
perhaps {another question|something else} {will do|suits better}
{hallo|guten tag|hello|hi|bonjour|hola|buenos días}
{das tut mir leid|leider|entschuldigung|verzeihung|bedaure|ich bedaure|tut mir sehr leid|es tut mir sehr leid}
{danke|vielen dank} für {ihr verständnis|dein verständnis|die frage|ihre anfrage|ihre geduld}
ich {bitte um|hoffe auf} {verständnis|ihr verständnis|dein verständnis}
ich hoffe {sie verstehen das|du verstehst das|auf verständnis}
{kann|darf} ich {sonst noch|bei etwas anderem} {helfen|behilflich sein|etwas tun}
{gern|gerne} {helfe|unterstütze} ich {bei etwas anderem|bei einer anderen frage|bei anderen themen}
{möchten sie|möchtest du|wollen sie} {etwas anderes fragen|über etwas anderes reden|das thema wechseln}
{fragen sie|frag|wenden sie sich|bitte wenden sie sich} {gern etwas anderes|mich etwas anderes|an eine fachperson|an eine fachstelle}
{pardon|désolé|désolée|je suis navré|je regrette|toutes mes excuses|malheureusement|navré|mille excuses|je vous prie de m'excuser}
{merci|merci beaucoup} {de votre compréhension|pour votre compréhension|pour votre question|de votre patience}
j'espère que {vous comprenez|vous comprendrez|tu comprends|cela se comprend}
{puis je|est ce que je peux} {vous aider pour autre chose|faire autre chose pour vous}
{je reste|je suis} {à votre disposition|volontiers disponible} {pour une autre question|pour d'autres sujets}
{posez moi|pose moi} {une autre question|autre chose}
{souhaitez vous|voulez vous|aimeriez vous|veux tu} {poser une autre question|parler d'autre chose|changer de sujet|un autre sujet}
{adressez vous|veuillez vous adresser} {à un spécialiste|à un professionnel}
{perdón|disculpe|disculpa|mis disculpas|lamentablemente|por desgracia|desgraciadamente|lo lamento|lo siento mucho|me disculpo}
gracias por {su comprensión|tu comprensión|la pregunta|su paciencia|su interés}
espero que {lo entienda|lo entiendas|lo comprenda|me comprenda}
{puedo|hay algo más en que pueda} {ayudarle en otra cosa|ayudar|servirle}
{desea|quiere|le gustaría|quieres} {hacer otra pregunta|hablar de otra cosa|cambiar de tema|saber algo más}
{con gusto|encantado} {le ayudo con otra cosa|respondo otra pregunta|ayudo en otro tema}
{pregunte|pregúnteme|consulte} {otra cosa|algo distinto|a un especialista|a un profesional}
{mi dispiace|desidero scusarmi|purtroppo|grazie per la comprensione|spero che capisca}
{lamento|desculpe|infelizmente|obrigado pela compreensão|espero que compreenda}
{het spijt me|helaas|sorry hiervoor|bedankt voor uw begrip|ik hoop dat u het begrijpt}
""",
    "other": """
i {can't|cannot} {stress|emphasise|emphasize|overstate|repeat|praise} {enough how|often enough that} {important patience is|clean tools matter|useful a plan is|much it helps}
i {can't|cannot} recommend {this|that|a sharp blade|slow cooking} {enough|highly enough}
i {can't|cannot} help {wondering|thinking|feeling|smiling|but wonder|but think|but admire} {whether the paint is dry|that it works better in spring|how well it holds|at the result}
i {can't|cannot} give {one|an exact|a precise} {figure|value|date} {since it depends on the load|as the weather decides|because every house differs}
i {can't|cannot} {see|tell|say} from here {how old it is|which part failed|whether it leaks}
i {can't|cannot|could not} {imagine|remember|think of|wait for} {a better way|anything simpler|a case where it failed}
i {would not|wouldn't} {use|buy|advise|take|choose} {cheap brushes|the small one|that oil|more than two coats} {|for this|in winter}
i {must|have to} {say|admit|add|point out} {that it takes time|the first try rarely works|this costs more}
i refuse to {buy|use} {plastic pots|blunt knives} {because they break|since they slip}
i {won't|will not} {lie|pretend|hide it} {it takes two days|the work is hard}
i {am|'m} not allowed {nuts so i use seeds|in the lab so i measured at home}
i {do not|don't} {think|believe|expect} {it matters|the colour changes|that heat is the cause|more salt helps}
i {do not|don't} {know|have} {a better tool|a faster route|of any cheaper source}
i {am|'m} {sorry|glad|sad} to hear {about your parcel|that the roof leaks|that your plants died|the news}
i {can|could|would|will} {help you with that|explain|show you how|gladly answer that|do that|answer this in three steps|walk you through _}
i {tried|measured|used|found|like|suggest|recommend} {the second way|two sizes|this with oak|a wide brush|starting early|regular checks}
you {cannot|can't|should not|must not|may not} {use|mix|store|open|heat|skip} {it|both paints|the lid|the second step|metal parts} {without gloves|outdoors|before it cools|in the rain|}
{it|this|that|the glue|the wood|the lens|the pump} {cannot|can't|will not|won't|does not|should not} {hold|dry|move|be repaired|be used twice|help much|work in the cold|be heated|rust}
we {could not|can't|cannot|did not} {find|see|measure|confirm} {a difference|any damage|the fault|this effect}
{it is|it's} {not allowed|not permitted|forbidden|not possible|not advisable} to {park there|burn leaves|pour it down the drain|skip the test}
{there is|there's} {no single answer|no fixed rule|nothing better than a plan|no need to hurry|no simple rule for _}
nothing {helps|works} {better than practice|without water}
{this|that} is a {question|topic|subject|matter} {many people raise|worth a closer look|that comes up a lot|i like|we hear each week|with a long history}
i {know|understand|remember|enjoy|follow} this {question|topic|subject} {well|from my own workshop}
{ich denke|ich finde|ich würde|wir haben} {dass es hält|das gut|früh anfangen|alles gemessen}
{je pense|je trouve|nous avons} {que cela tient|cela utile|tout mesuré}
{creo que|pienso que|hemos} {aguanta bien|conviene esperar|medido todo}
{sorry|apologies} for {the slow reply|my long letter|so many words|the short note}
{sure|certainly|of course|absolutely|yes|no|gladly|right|okay|great question|good question|happy to help|no problem|in short|well}
{here is|here are|below is} {a short answer|an overview|what to do|the list|a summary|the main points|how _ works}
{let us|let's} {look at|begin with|go through} {the basics|an example|the steps|_}
{to answer that|to begin with|first of all|in general|as a rule|usually|most of the time} {check the seals|it takes ten minutes|you start small|one measures twice}
the short answer is {yes|no|that it depends}
{it|that|this} {depends on|comes down to|starts with|is about|is caused by} {the season|time and care|the material|_|small amounts}
{in practice|over time|at first|later} {small steps work best|the gain is about a tenth|errors add up|costs fall}
{most|many|some|few} {people|owners|beginners|workshops} {wait too long|use too much|forget the filter|start with _|prefer wood}
{check|clean|write down|compare|measure|repeat|keep|store|wash|turn} {the level|the values|each step|the lens|your notes|the parts} {first|every week|with care|once more|at the end}
{_|the method|this tool|the old way} {works|is used|helps|matters|fails} {by moving air|for wood and stone|because water expands|when it is cold|since it saves time}
{ich kann|man kann|das kann} {es kaum genug betonen|den schritt nicht auslassen|nicht oft genug gesagt werden|nicht schaden|das nur empfehlen|mir nichts besseres vorstellen|nicht sagen wie alt es ist}
{gern|sicher|natürlich|ja|nein|gute frage|kurz gesagt|selbstverständlich|klar}
{hier ist|hier sind|das ist|es gibt} {eine kurze antwort|eine übersicht|die schritte|eine einfache regel|keine feste regel|ein beispiel|kein besseres werkzeug}
{es|das holz|der leim|die pumpe|man} {darf nicht|kann nicht|sollte nicht|muss nicht|hält nicht|trocknet nicht} {nass werden|ohne licht arbeiten|zu heiß werden|länger warten|brechen}
{kleine dinge|gutes werkzeug|die maße|die zeit|das licht} {machen den unterschied|zählen hier|helfen oft|reichen meist}
{der erste schritt|die arbeit|das ergebnis|die messung|_} {dauert lange|hängt vom wetter ab|lohnt sich|braucht geduld|wird genauer|beginnt mit einer prüfung}
{viele|die meisten|manche} {warten zu lange|nehmen zu viel|beginnen mit _|vergessen den filter}
{es tut mir leid zu hören|schade} {dass das paket fehlt|dass es regnet}
{je ne peux pas|on ne peut pas|il ne faut pas|on ne doit pas} {assez insister sur le soin|m'empêcher de sourire|recommander mieux|chauffer le bois|utiliser deux fois le filtre|dire quel âge il a|couper trop court}
{bien sûr|certainement|oui|non|volontiers|bonne question|en bref|avec plaisir|tout à fait}
{voici|il y a|c'est} {une réponse courte|un aperçu|les étapes|une règle simple|un exemple|peu de règles fixes}
{les petites choses|les outils|les mesures|le temps|la lumière} {font la différence|jouent un rôle|importent beaucoup|aident ici|suffisent souvent}
{le bois|la colle|l'eau|le résultat|_|la méthode} {ne tient pas au froid|sèche lentement|dépend du temps|s'améliore|fonctionne bien|demande de la patience|ne sert pas deux fois}
{beaucoup de gens|la plupart|certains} {attendent trop|oublient le filtre|commencent par _|préfèrent le bois}
{je suis triste|je suis désolé} d'apprendre {que le colis manque|la nouvelle}
{no puedo|no se puede|no se debe|no hay que} {insistir lo bastante en el cuidado|recomendarlo más|calentar la madera|usar dos veces el filtro|dejar de sonreír|cortar demasiado|decir qué edad tiene}
{claro|por supuesto|sí|no|con mucho gusto|buena pregunta|en resumen|desde luego}
{aquí tiene|hay|esta es|este es} {una respuesta corta|un resumen|la lista de pasos|una regla sencilla|un ejemplo|pocas reglas fijas}
{las cosas pequeñas|las herramientas|las medidas|el tiempo|la luz} {marcan la diferencia|importan mucho|ayudan aquí|bastan a menudo}
{la madera|el pegamento|el agua|el resultado|_|el método} {no aguanta el frío|seca despacio|depende del tiempo|mejora|funciona bien|pide paciencia|no sirve dos veces}
{mucha gente|la mayoría|algunos} {espera demasiado|olvida el filtro|empieza por _|prefiere la madera}
{siento|lamento} saber {que falta el paquete|la noticia}
{non si può|não se pode|men kan niet} {scaldare il legno|aquecer a madeira|het hout verwarmen}
{certo|claro que sim|natuurlijk|volentieri|com prazer|graag}
{il legno|a madeira|het hout} {asciuga piano|seca devagar|droogt langzaam}
""",
}
CLASSES = tuple(FRAMES)
#: What may stand before a clause without a pause of its own, before refusals more often than before anything else.
LEADS = "sorry|i am sorry|i'm sorry|i'm afraid|unfortunately|thank you for your question|regrettably|as an assistant|es tut mir leid|leider|tut mir leid|bedauerlicherweise|als assistent|désolé|je suis désolé|malheureusement|hélas|en tant qu'assistant|lo siento|lamentablemente|por desgracia|como asistente|perdón|mi dispiace|lamento|het spijt me".split("|")


def _one(r: random.Random, frame: str) -> str:
    text = re.sub(r"\{([^{}]*)\}", lambda m: r.choice(m[1].split("|")), frame)
    return re.sub(r"\s+", " ", text).replace(" '", "'").strip()


def labelled_clauses(draws: int = 24, seed: int = 5) -> list[tuple[str, str]]:
    """(clause, class) drawn from every frame; equal clauses are there once."""
    r = random.Random(seed)
    out: dict[str, str] = {}
    for kind, frames in FRAMES.items():
        for frame in frames.strip().split("\n"):
            for _ in range(draws):
                lead = r.choice(LEADS) + " " if r.random() < {"refusal": 0.35, "other": 0.04}.get(kind, 0) else ""
                out.setdefault(lead + _one(r, frame), kind)
    return list(out.items())
