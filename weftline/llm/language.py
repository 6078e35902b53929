"""Which language a short text is in: naive Bayes over letter groups, trained on a few paragraphs of everyday prose."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np

SAMPLES = {
    "en": """The house at the end of the road is old, but it has a good roof and a large garden. We should have told them that the
train leaves after the storm. When you come home you can see what is on the table and who is at the door. I do not know why they
are so quiet; perhaps there is nothing left to say. Most people would rather wait than pay for something they cannot use. If this
works, repeat it every day and write down what you find. It usually takes about ten minutes and needs no special tools. Check the
weather first because it can slow everything down. How much time does it take, and which mistakes are common? Please give me a
short answer. Thank you for your message, everything else works as described. She said that he had been there since the morning.
Would you like to know more? Costs stay low since each part may be used again. Sorry, this is what happened with our order.""",
    "de": """Das Haus am Ende der Straße ist alt, aber es hat ein gutes Dach und einen großen Garten. Wir hätten ihnen sagen müssen,
dass der Zug nach dem Sturm abfährt. Wenn du nach Hause kommst, siehst du, was auf dem Tisch liegt und wer vor der Tür steht. Ich
weiß nicht, warum sie so still sind; vielleicht gibt es nichts mehr zu sagen. Die meisten Leute warten lieber, als für etwas zu
zahlen, das sie nicht brauchen. Man wiederholt es jeden Tag und schreibt auf, was sich ergibt. Es dauert etwa zehn Minuten und braucht
kein besonderes Werkzeug. Wie viel Zeit kostet das und welche Fehler sind häufig? Bitte gib mir eine kurze Antwort. Vielen Dank für
die Nachricht, alles andere funktioniert wie beschrieben. Sie sagte, dass er seit dem Morgen da gewesen sei. Möchten Sie noch etwas
wissen? Die Kosten bleiben niedrig, weil jedes Teil wieder verwendet wird. Leider ist das mit unserer Bestellung passiert.""",
    "fr": """La maison au bout de la rue est vieille, mais elle a un bon toit et un grand jardin. Nous aurions dû leur dire que le
train part après l'orage. Quand tu rentres chez toi, tu vois ce qui est sur la table et qui est à la porte. Je ne sais pas pourquoi
ils sont si calmes ; peut-être qu'il n'y a plus rien à dire. La plupart des gens préfèrent attendre plutôt que de payer pour quelque
chose dont ils n'ont pas besoin. On le refait chaque jour et on note ce que l'on trouve. Cela prend environ dix minutes et ne demande
aucun outil. Combien de temps faut-il, et quelles erreurs voit-on souvent ? Donne-moi une réponse courte. Merci pour votre message,
tout le reste marche comme prévu. Elle a dit qu'il était là depuis le matin. Avez-vous une autre question ? Les frais restent bas
parce que chaque pièce sert encore. Je suis désolé, c'est ce qui est arrivé avec notre commande. Pensez à regarder le temps.""",
    "es": """La casa al final de la calle es vieja, pero tiene un buen techo y un jardín grande. Tendríamos que haberles dicho que el
tren sale después de la tormenta. Cuando llegas a casa, ves lo que hay sobre la mesa y quién está en la puerta. No sé por qué están
tan callados; quizás ya no queda nada que decir. La mayoría de la gente prefiere esperar antes que pagar por algo que no necesita. Se
repite cada día y se anota lo que aparece. Lleva unos diez minutos y no necesita herramientas. ¿Cuánto tiempo hay que reservar y qué
errores son frecuentes? Dame una respuesta corta. Gracias por su mensaje, todo lo demás funciona como se describe. Ella dijo que él
había estado allí desde la mañana. ¿Quiere preguntar otra cosa? Los gastos son bajos porque cada pieza se usa otra vez. Lo siento, es
lo que pasó con nuestro pedido. Una buena luz ayuda cuando varias personas comparten el trabajo. Conviene mirar el tiempo antes. Después se compara el
resultado con las últimas lecturas. Un plan escrito ayuda cuando hay poco espacio.""",
    "it": """La casa in fondo alla strada è vecchia, ma ha un buon tetto e un grande giardino. Avremmo dovuto dire loro che il treno
parte dopo il temporale. Quando torni a casa, vedi che cosa c'è sul tavolo e chi è alla porta. Non so perché siano così silenziosi;
forse non c'è più niente da dire. La maggior parte della gente preferisce aspettare piuttosto che pagare per qualcosa che non serve.
Si ripete ogni giorno e si annota quello che si trova. Ci vogliono circa dieci minuti e nessun attrezzo. Quanto tempo richiede e quali
errori sono frequenti? Dammi una risposta breve. Grazie per il messaggio, tutto il resto funziona come previsto. Lei ha detto che lui
era lì dalla mattina. Vuole sapere altro? Le spese restano basse perché ogni pezzo si usa di nuovo. Mi dispiace, è quello che è
successo con il nostro ordine. Una luce buona aiuta quando più persone dividono il lavoro. Poi si confronta il risultato con gli ultimi.""",
    "pt": """A casa no fim da rua é velha, mas tem um bom telhado e um jardim grande. Devíamos ter-lhes dito que o comboio sai depois da
tempestade. Quando chegas a casa, vês o que está em cima da mesa e quem está à porta. Não sei por que estão tão calados; talvez já não
haja nada a dizer. A maioria das pessoas prefere esperar a pagar por uma coisa de que não precisa. Repete-se todos os dias e anota-se o
que se encontra. Leva cerca de dez minutos e não precisa de ferramentas. Quanto tempo é preciso e quais são os erros mais comuns? Dê-me
uma resposta curta. Obrigado pela mensagem, tudo o resto funciona como descrito. Ela disse que ele estava lá desde manhã. Quer saber
mais alguma coisa? Os custos ficam baixos porque cada peça é usada outra vez. Lamento, foi o que aconteceu com a nossa encomenda. Uma
luz boa ajuda quando várias pessoas dividem o trabalho. Depois compara-se o resultado com as últimas. Começa com uma verificação.""",
    "nl": """Het huis aan het eind van de straat is oud, maar het heeft een goed dak en een grote tuin. We hadden hun moeten zeggen dat de
trein na de storm vertrekt. Als je thuiskomt, zie je wat er op de tafel ligt en wie er aan de deur staat. Ik weet niet waarom ze zo
stil zijn; misschien valt er niets meer te zeggen. De meeste mensen wachten liever dan te betalen voor iets wat ze niet nodig hebben. Je
herhaalt het elke dag en schrijft op wat je vindt. Het duurt ongeveer tien minuten en vraagt geen bijzonder gereedschap. Hoeveel tijd
kost het en welke fouten komen vaak voor? Geef me een kort antwoord. Bedankt voor het bericht, al het andere werkt zoals beschreven. Zij
zei dat hij er sinds de ochtend was. Wilt u nog iets weten? De kosten blijven laag omdat elk deel opnieuw gebruikt wordt. Het spijt me,
dat is er met onze bestelling gebeurd. Goed licht helpt als meer mensen het werk delen. Daarna vergelijk je de waarde met de laatste.""",
    "pl": """Dom na końcu ulicy jest stary, ale ma dobry dach i duży ogród. Powinniśmy byli im powiedzieć, że pociąg odjeżdża po burzy. Kiedy
wracasz do domu, widzisz, co leży na stole i kto stoi przy drzwiach. Nie wiem, dlaczego są tacy cisi; może nie ma już nic do powiedzenia.
Większość ludzi woli czekać niż płacić za coś, czego nie potrzebuje. Powtarza się to każdego dnia i zapisuje wyniki. Trwa to około
dziesięciu minut. Ile to zajmuje czasu i jakie błędy są częste? Dziękuję za wiadomość, wszystko inne działa zgodnie z opisem.""",
    "sv": """Huset i slutet av gatan är gammalt, men det har ett bra tak och en stor trädgård. Vi borde ha sagt till dem att tåget går efter
ovädret. När du kommer hem ser du vad som ligger på bordet och vem som står vid dörren. Jag vet inte varför de är så tysta; kanske finns
det inget mer att säga. De flesta väntar hellre än att betala för något de inte behöver. Man upprepar det varje dag och skriver ner vad
man hittar. Det tar ungefär tio minuter. Hur mycket tid tar det och vilka fel är vanliga? Tack för meddelandet, allt annat fungerar.""",
}
#: How each language is named in the languages of the questions.
NAMED = {
    "en": r"english|englisch\w*|anglais|inglés",
    "de": r"german|deutsch\w*|allemand|alemán",
    "fr": r"french|französisch\w*|français|francés",
    "es": r"spanish|spanisch\w*|espagnol|español",
    "it": r"italian|italienisch\w*|italien|italiano",
    "pt": r"portuguese|portugiesisch\w*|portugais|portugués",
    "nl": r"dutch|niederländisch\w*|néerlandais|neerlandés|holandés",
    "pl": r"polish|polnisch\w*|polonais|polaco",
    "sv": r"swedish|schwedisch\w*|suédois|sueco",
}
_NAMED = {k: re.compile(rf"\b(?:{v})\b", re.I) for k, v in NAMED.items()}


WORD = re.compile(r"[^\W\d_]+")


def _grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for n in (1, 2, 3, 4) for i in range(len(padded) - n + 1)] + ["=" + word] * 3


@lru_cache(maxsize=1)
def _model() -> tuple[tuple[str, ...], dict[str, np.ndarray]]:
    counts = {lang: Counter(g for w in WORD.findall(text.lower()) for g in _grams(w)) for lang, text in SAMPLES.items()}
    known = sorted(set().union(*counts.values()))
    totals = np.array([sum(c.values()) + 0.3 * len(known) for c in counts.values()])
    return tuple(counts), {g: np.log((np.array([c[g] for c in counts.values()]) + 0.3) / totals) for g in known}


@lru_cache(maxsize=200_000)
def _word(word: str) -> np.ndarray:
    _, weights = _model()
    return sum((weights[g] for g in _grams(word) if g in weights), np.zeros(len(SAMPLES)))


def scores(text: str) -> dict[str, float]:
    """Log-likelihood of each language; empty for a text without words."""
    words = WORD.findall(text.lower())
    return dict(zip(_model()[0], np.add.reduce(list(map(_word, words))).tolist())) if words else {}


def language(text: str) -> str | None:
    """The most likely language, or None for a text without words."""
    s = scores(text)
    return max(s, key=s.__getitem__) if s else None


def named_languages(text: str) -> set[str]:
    """Languages the text names."""
    return {k for k, r in _NAMED.items() if r.search(text)}
