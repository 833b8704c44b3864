"""Problem 10: template residue, filler, error pages and script notices where a text should be.

One pass of a keyword automaton over each text tells what to try at all, for most texts nothing. Placeholders that were never
filled are found by one grammar per delimiter. Messages of pages and programs are told by their structure, not by phrases: such a
sentence speaks of a thing of the system (page, request, session, script ...), says that it failed, lacks something or must be
switched on, and is dense in the small vocabulary that interfaces have for this, in any of the languages, while no person tells
it. Filler asks for a text to be put somewhere or calls itself a stand-in; Latin filler is told by density alone.

Context discounts: what stands in quotation marks or code is somebody's quotation; a placeholder in a sentence, or a text full
of code, that speaks of templates, placeholders or syntax is a tutorial's; a name in a delimiter that people use as well counts
only if it is a field's name or written as an identifier; a sentence with a first person, relatives or a time told is a
reviewer's.

Result: one row per id and kind: placeholder, filler, error_page, script_notice.

Defined results: null, empty and white-space texts have no residue; letter case doesn't matter; whole texts are read, names,
quotations and sentences of any length; repeated ids come out once a row; an empty table gives no rows. Only the two named
columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # the keys are then sought one by one
    ahocorasick = None

#: Names of fields as templates write them, without case, spaces, points and underscores.
FIELDS = frozenset(
    "product productname item itemname itemtitle store storename shop shopname brand brandname model category customer customername name firstname lastname fullname username user title reviewer author city company price date color colour email "
    "produkt produktname artikel artikelname marke modell haendler händler vorname nachname kunde kundenname kategorie geschäft "
    "produit nomproduit nomduproduit article marque modele modèle magasin boutique prenom prénom nom client catégorie categorie "
    "producto nombreproducto nombredelproducto articulo artículo marca modelo tienda nombre apellido cliente categoria categoría "
    "prodotto nomeprodotto articolo modello negozio nome cognome produto nomeproduto nomedoproduto artigo loja "
    "商品名 商品 店名 店舗名 ブランド ブランド名 名前 お名前 氏名 品名 モデル カテゴリ カテゴリー".split()
)

#: The words of the usual Latin filler.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat "
    "duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)


# ---- placeholders

_NAME = r"[^\W\d][\w.\- ]*?"

#: Delimiters that nothing but a template has.
PLAIN = re.compile(
    "|".join(
        [
            r"\{\{\{?\s*[#/^>&!]?\s*[^\W\d][^{}\n]*",  # closed or cut off
            r"\$\{[^\W\d][\w.]*\}?",
            r"#\{[^\W\d][\w.]*\}",
            r"<%[=\-#]?[^%\n]+%>",
            r"\{%-?\s*\w[^%\n]*%\}",
            rf"\[\[\s*{_NAME}\s*\]\]",
            r"%\([\w.]+\)[sdr]",
            r"(?<![A-Za-z0-9_%])%(?:\d+\$)?[sd](?![A-Za-z0-9_%])",
            r"(?<![A-Za-z0-9_%])%%?[^\W\d_][\w.]+%(?![A-Za-z0-9_])",
            r"(?<![A-Za-z0-9_$])\$[^\W\d_][\w.]+\$(?![A-Za-z0-9_])",
            r"@@[^\W\d][\w.]*@@",
            r"##[^\W\d][\w.]*##",
            rf"<<\s*{_NAME}\s*>>",
            r"\*\|[\w.: ]+\|\*",
            r"(?<![\w{])\{\d+\}(?!\})",
            r"\[object object\]",
            r"(?<![A-Za-z0-9_\"'-])undefined(?![A-Za-z0-9_\"'-])",
            r"\(null\)",
            r"<!--\s*TODO\b",
        ]
    ),
    re.I,
)

#: Brackets around a demand to fill in something: a verb of filling, or a thing with a word for "here".
BLANK = re.compile(r"\[([^\[\]\n]+)\]|\(([^()\n]+)\)|（([^（）\n]+)）")

#: Delimiters that people use as well: only a field's name or an identifier counts.
AMBIGUOUS = re.compile(rf"(?<!\{{)\{{({_NAME})\}}(?!\}})|(?<!\[)\[({_NAME})\](?![\](])|(?<![<])<({_NAME})>(?!>)|&lt;({_NAME})&gt;|__({_NAME})__", re.I)
_IDENTIFIER = re.compile(r"[^\W\d]+(?:[_.][^\W_]+)+|[a-z]+[A-Z]\w*")

#: A quotation opens before a word and closes behind one, so the mark of inches opens none.
QUOTED = re.compile(r"(?<![\w.\"])\"(?=[^\s\"])[^\"\n]*\"(?!\w)|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]|「[^」\n]*」|『[^』\n]*』|‘[^’\n]*’|```.*?(?:```|\Z)|`[^`\n]+`|<code>.*?</code>|<pre>.*?</pre>", re.S | re.I)
_CODE_BLOCK = re.compile(r"```|<code>|<pre>", re.I)

#: Speaking of templates as one's subject.
ABOUT = re.compile(r"\b(?:templates?|placeholders?|tutorials?|syntax|variables?|documentation|vorlagen?|platzhalter|modèles? de (?:page|texte)|plantillas?|modello di pagina|gabarits?)\b|テンプレート|プレースホルダ", re.I)

# ---- messages: the words of interfaces by what they mean, in seven languages

_MEANS = {
    # a thing of the system
    "thing": """page pages site website server servers request requests resource resources listing url link feed content contents session gateway service services connection database browser network upstream host domain section module widget address file document comments comment review reviews token login access permission response http https status ref reference trace incident request-id trace-id code webpage webpages web app application applications system gateways account accounts profile widgets image images video data api endpoint proxy firewall certificate dns cache user users ip
        seite seiten webseite website anfrage anfragen ressource inhalt inhalte sitzung dienst verbindung datenbank netzwerk adresse datei zugriff bewertung bewertungen abschnitt serverfehler
        page pages site serveur requête requêtes ressource contenu session service connexion réseau adresse fichier accès avis passerelle section
        página páginas sitio servidor solicitud solicitudes recurso contenido sesión servicio conexión red dirección archivo acceso opinión opiniones reseña reseñas sección navegador
        pagina pagine sito richiesta richieste risorsa contenuto sessione servizio connessione rete indirizzo accesso recensione recensioni sezione
        site pedido solicitação recurso conteúdo sessão serviço conexão rede endereço arquivo acesso avaliação avaliações seção""",
    # failure by itself
    "fail": """error errors failed fails failure unavailable expired denied rejected blocked forbidden refused unauthorized unauthorised invalid broken unexpected timed timeout crashed unreachable unsupported exceeded wrong bad permission broke reset closed limited restricted suspended disconnected aborted interrupted terminated corrupted offline maintenance time-out timeouts outage overloaded insufficient undefined uncaught unhandled fatal unable impossible credentials
        fehler serverfehler fehlgeschlagen abgelaufen verweigert abgelehnt blockiert verboten ungültig gesperrt unerwarteter fehlerhaft
        erreur erreurs introuvable indisponible expiré expirée refusé refusée rejeté rejetée bloqué bloquée interdit interdite échoué échec inaccessible invalide
        error errores caducado caducada expirado expirada denegado denegada rechazado rechazada bloqueado bloqueada prohibido prohibida fallado fallo inválido inválida
        errore errori scaduta scaduto negato negata rifiutato rifiutata respinto respinta bloccato bloccata vietato fallito fallita irraggiungibile
        erro erros expirou expirada expirado negado negada rejeitado rejeitada recusado recusada bloqueado bloqueada proibido falhou indisponível inválido""",
    # what can't be done when it is denied
    "able": """found available exist exists loaded load displayed shown reached located processed opened completed accessed rendered retrieved connect connected reachable supported valid permitted allowed authorized authorised respond responding longer view process load fetch fetched find open complete retrieve connect reach read save saved access display establish established establishing verify verified resolve resolved authenticate authenticated render receive received send sent handle handled start started service working responding
        gefunden verfügbar erreichbar vorhanden existiert geladen angezeigt verarbeitet geöffnet erlaubt laden anzeigen aufgerufen hergestellt antwortet berechtigt verarbeiten öffnen finden empfangen bearbeitet gesendet beantwortet möglich
        trouvée trouvé chargée chargé disponible affichée affiché existe traitée accessible plus charger afficher trouver accéder traiter ouvrir joindre établir répond autorisé permet possible valide réussi abouti
        encontrada encontrado encontró encuentra cargar cargada disponible existe mostrar procesar procesada accesible acceder abrir encontrar conectar responde autorizado mostrarse cargarse permite completar posible válida válido
        trovata trovato disponibile esiste raggiungibile caricata caricato caricare visualizzata mostrata mostrato elaborata caricare visualizzare accedere aprire trovare connettersi risponde autorizzato riuscita riuscito completata possibile valida valido accessibile
        encontrada encontrado carregada carregado disponível existe exibida acessível processada carregar exibir acessar aceder abrir encontrar processar conectar responde autorizado permite concluída possível válida válido""",
    "not": """not cannot can't couldn't doesn't isn't wasn't no longer unable without don't
        nicht kein keine ohne nichts
        ne n'a n'existe n'est pas plus sans aucun aucune impossible
        no sin ningún ninguna imposible
        non senza nessun nessuna impossibile
        não sem nenhum nenhuma impossível""",
    # what a visitor is told to do
    "act": """try retry reload refresh return go back sign log contact check wait later again
        versuchen sie erneut später zurück neu laden anmelden melden prüfen
        réessayer réessayez veuillez retour retourner revenir recharger rechargez reconnecter reconnectez
        intente intentarlo inténtelo vuelva volver recargue recargar regresar inicie
        riprovare riprova torna tornare ricaricare ricarica accedere
        tente tentar volte voltar recarregue recarregar entrar faça""",
    # scripts, and that they are off or wanted
    "script": """javascript js script scripts scripting skript skripte skripten scripte script gli-script""",
    "want": """enable enabled activate activated allow allowed turn turned switch switched required requires require needed needs need must loaded disabled deactivated off blocks blocked without on
        aktivieren aktiviert erlauben erlaubt einschalten eingeschaltet benötigt benötigen erforderlich deaktiviert ausgeschaltet blockiert ohne müssen muss
        activer activez activé autoriser autorisez nécessite nécessaire requis faut doit activé permet bloque activez activé nécessitent bloqués bloqué désactivé désactivés sans
        active activar habilite habilitar permita permitir necesita necesitas necesario activa habilita debe debes activado habilitado desactivada requiere bloquea desactivado desactivados sin permite
        attivare attiva attivi abilitare abilita consentire attivato abilitato devi deve richiede richiede necessario necessita occorre blocca disattivato disattivati senza bisogna
        ative ativar ativos ativado habilitado precisa deve habilite habilitar permita permitir precisa necessário requer bloqueia desativado desativados sem permite""",
    # a text to come, a stand-in, putting it, and where
    "text": """text texts headline title copy paragraph quote opinion content body review description caption
        text texte titel überschrift inhalt absatz bewertung meinung beschreibung zitat bewertungstext kundenzitat
        texte titre contenu paragraphe avis citation description
        texto título contenido párrafo opinión reseña cita descripción
        testo titolo contenuto paragrafo recensione opinione citazione descrizione
        texto título conteúdo parágrafo avaliação opinião citação descrição""",
    "dummy": """placeholder dummy sample example filler lorem ipsum todo tbd
        blindtext mustertext platzhalter beispieltext fülltext platzhaltertext
        remplissage factice exemple provisoire
        relleno ejemplo provisional
        segnaposto esempio riempitivo
        exemplo preenchimento""",
    "put": """put paste type write insert add enter replace replaced fill goes ignore provide describe
        einfügen einsetzen eintragen ergänzen schreiben ersetzt ersetzen ersetzen steht
        insérer insérez placer mettre ajouter écrire remplacer saisir saisissez écrivez ajoutez remplacez placez mettez
        insertar inserte poner escribir añadir colocar sustituir va escriba inserte ponga añada coloque introduzca
        inserire mettere scrivere aggiungere sostituire va inserisci inserisca scrivi scriva aggiungi sostituisci
        inserir insira colocar escrever pôr substituir vai adicionar escreva adicione insira coloque""",
    "here": "here hier ici aquí aqui qui",
    # the glue of such sentences
    "glue": """the a an this that these those is are was be been being has have had do does could can may might should would will to of for in into on at by with from and or if but please sorry we our you your it its they them there which who when while after before some any all part parts more now currently temporarily right soon few minutes seconds ms moment moments time requested asked looking moved removed permanently team notified administrator support webmaster problem problems persists start home homepage reach oops something went occurred happened encountered processing loading rendering opening internal too many security reasons reason see visit continue display showing work works read full experience settings cookies first another item product store shop as not-found looks like appears seems client-side active execution client side turned box launch publishing publish before short max test customer customer's our side end returned returns sent gave chars maximum moved upon loading characters words goes later version test real final his next us kindly read end own run apps functionality function functions necessary correctly properly using use uses following them refused try-again due because unable was fine ok okay about timely response region country properly site's back here's also enable following an
        die der das dem den des ein eine einen dieser diese dieses ist sind wird wurde wurden konnte konnten kann können werden hat haben und oder aber bitte leider derzeit momentan zur zum zu von vom für im in auf auf an mit um bei ihre ihr ihrer ihren sie wir angeforderte angeforderten interner internes startseite neu noch einmal minuten aktive inhalte browser server einstellungen alle zuerst lesen sehen später stelle dieser dann server artikel produkt es um ob beim wegen durch fehlgeschlagen anzuzeigen nutzen verwenden darauf haben hast du dein deine vorübergehend ihrem ihres unserem unser unsere seinem timely kunde kunden veröffentlichung vor max kurzer kurzen kurze kurzes zurückgegeben zeichen aufgetreten ein antwortet zurzeit
        la le les l un une des du de d et ou mais est sont été être a au aux en dans sur pour par ce cet cette ces votre vos nous vous il elle demandée demandé momentanément temporairement actuellement interne accueil d'accueil quelques minutes instants puis cette exécution l'exécution navigateur peuvent s'afficher afficher vérifiez réglages fonctionne lire voir avis merci activez-le court courte caractères publier avant l'accueil peut n' plus tard produit article se ne renvoyé pour afin utiliser avez vous peut-être lorsque commentaires doit recherchée recherchez inattendue notre nos ceci client mise ligne survenue lors chargement produite
        el la los las un una unos de del al y o pero es son está están fue ha sido en este esta esto su sus le lo se por para con que pudo puede pueden momento solicitada solicitado interno inicio dentro minutos ejecución ajustes revise ver leer funciona más tarde tiene producto artículo temporalmente comentarios usar esta ser haber hay ahora ocurrido inesperado busca buscada nuestro nuestra tu tus antes publicar caracteres breve cliente máx corto curto producido cargar ocorreu ao carregar
        il lo la i gli le un uno una di del della dei delle al alla e o ma è sono stata stato essere può possono in su per con da dal dalla questo questa suo sua si che richiesta richiesto momento momentaneamente interno iniziale iniziale più tardi prima pubblicare caratteri breve cliente max verificato durante caricamento server browser esecuzione dell'esecuzione l'esecuzione impostazioni vedere leggere funziona prodotto articolo visualizzare commenti usare temporaneamente ora non nel nella sul tuo tua nostro cerca cercata cercato inatteso imprevisto
        o a os as um uma de do da dos das ao à e ou mas é são foi ser está estão em no na este esta seu sua se por pelo pela para com que pôde possível pode podem solicitada solicitado pedida momento interno inicial dentro minutos tarde mais execução configurações verifique ver ler funciona temporariamente comentários usar agora favor servidor procura procurada inesperado nosso nossa no na sua seu navegador produto artigo antes publicar caracteres breve cliente máx corto curto producido cargar ocorreu ao carregar""",
}
#: A reviewer's own telling: first persons, relatives, a time or a purchase told.
_TELLING = frozenset(
    """i i'm i've i'd i'll my me mine myself dad mum mom mother father husband wife daughter son friend sister brother neighbour neighbor kids evening week weeks month months yesterday twice bought ordered pay battery
    ich mein meine meinen meinem meiner mich mir mutter vater mann frau tochter sohn freund gekauft bestellt abends woche zweimal
    je j'ai j'avais mon ma mes moi me mari femme fille fils mère père acheté commandé semaine soir payer
    yo mi mis me mí marido mujer hija hijo madre padre compré pedí tuve semana noche pagar
    io mio mia miei mie mi ho marito moglie figlia figlio madre padre comprato ordinato settimana sera pagare
    eu meu minha meus minhas me mim marido mulher filha filho mãe pai comprei pedi semana noite pagar""".split()
)
_CONCEPTS = {name: 1 << i for i, name in enumerate(_MEANS)}
_BITS: dict[str, int] = {}
for _name, _words in _MEANS.items():
    for _w in _words.split():
        _BITS[_w] = _BITS.get(_w, 0) | _CONCEPTS[_name]
_THING, _FAIL, _ABLE, _NOT, _ACT, _SCRIPT_WORD, _WANT, _TEXT, _DUMMY, _PUT, _HERE, _GLUE = _CONCEPTS.values()
_STATUS = re.compile(r"[1-5]\d\d|10\d\d")
#: Share of a message's words that interfaces use.
DENSE = 0.85

#: Japanese has no spaces: what a sentence must hold of each meaning.
_JA = {
    "error_page": (re.compile("発生しました|ページ|サーバー?|セッション|アクセス|サービス|リクエスト|コンテンツ|接続|レビュー|しばらく"), re.compile("見つかりません|存在しません|エラー|問題が発生|できません|拒否|禁止|期限|切れ|失敗|もう一度お試し|表示できません|利用できません")),
    "script_notice": (re.compile("javascript|スクリプト", re.I), re.compile("(?:有効に|許可|オンに)(?:して|する)|無効|必要|なしでは|ブロックされ")),
    "filler": (re.compile("ここに|サンプルテキスト|ダミーテキスト|プレースホルダ|仮のテキスト"), re.compile("入ります|入力|記入|挿入|サンプルテキスト(?:サンプル|です)|ダミーテキスト(?:ダミー|です)|仮のテキスト")),
}
_JA_TELLING = re.compile("私|僕|妻|夫|娘|息子|買っ|購入|と書いて|と出て|でした")

#: What programs write when they fail.
PROGRAM = re.compile(
    r"\{\s*\"(?:status|code|error|message)\"\s*:\s*[\d\"]|traceback \(most recent call last\)|\bsqlstate\[|<error>\s*<code>|<code>\w+</code>\s*<message>|^\s*file \"[^\"\n]+\", line \d+|^\s*at [\w.$<>]+ ?\([\w./-]+\.(?:java|js|ts|py|cs|go|rb|php|kt|rs|scala|cpp):\d+(?::\d+)?\)|\b(?:[a-z]\w*\.)+[a-z]\w*(?:exception|error)\b|\bfatal error: uncaught\b|^\W*\w*(?:error|exception): '[^'\n]*'\s*$|^\W*(?:request|trace|incident|reference)[- ]?id:? [0-9a-f-]{6,}|^\W*(?:warning|notice|fatal error|parse error): .* on line \d+\s*$",
    re.I | re.M,
)

_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=。)|\n+|\s\|\s|</?\w+>|<!--|-->")
_RUN_ON = re.compile(r"(?<=[^\W_])\s+(?=[A-ZÀ-Þ])")
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_KANA = re.compile(r"[぀-ヿ一-鿿]")


@lru_cache(1 << 16)
def _meaning(token: str) -> int:
    """The concepts of a word; of one with an apostrophe or hyphen, those of its parts. -1: a reviewer's word."""
    token = token.replace("’", "'")
    if token in _TELLING:
        return -1
    bits = _BITS.get(token, 0)
    if not bits and ("'" in token or "-" in token):
        parts = [_meaning(x) for x in re.split(r"['-]", token) if x]
        if -1 in parts:
            return -1
        bits = 0
        for x in parts:
            bits |= x
        return bits if all(parts) else 0
    if not bits and token.isdecimal():
        return _GLUE
    return bits


def _told(sentence: str) -> bool:
    return any(_meaning(t.lower()) < 0 for t in _TOKEN.findall(sentence))


def _message(sentence: str) -> set[str]:
    """The kinds of message a sentence is by its structure."""
    if _KANA.search(sentence):
        return set() if _JA_TELLING.search(sentence) else {k for k, tests in _JA.items() if all(t.search(sentence) for t in tests)}
    tokens = [t.lower() for t in _TOKEN.findall(_MANY.sub("request error", _ACTIVE.sub("skripte", sentence)))]
    held = known = glue = 0
    for t in tokens:
        m = _meaning(t)
        if m < 0:
            return set()
        held |= m
        known += m != 0
        glue += m == _GLUE
    n = len(tokens)
    if not held & ~_GLUE or known < DENSE * n or n < 2:
        return set()
    found = set()
    scripts, failed = held & _SCRIPT_WORD, held & _FAIL or held & _NOT and held & _ABLE
    if scripts and held & _WANT and not _NO_NEED.search(sentence):
        found.add("script_notice")
    elif failed and (held & (_THING | _SCRIPT_WORD) or any(_STATUS.fullmatch(t) or t in _OCCURS for t in tokens)) or _is_advice(tokens, held):
        found.add("error_page")
    first = _meaning(tokens[0])
    if held & _DUMMY and (held & _PUT or first & (_DUMMY | _TEXT) or tokens[0] in _THIS or tokens.count(tokens[0]) > 1) or held & _TEXT and tokens[-1] in _HERES and known == n or held & _TEXT and held & _PUT and (held & _HERE or _WHERE.search(sentence)):
        found.add("filler")
    return found


_ACTIVE = re.compile(r"\baktiven? inhalten?\b", re.I)
_MANY = re.compile(r"\btoo many requests\b", re.I)
_WHERE = re.compile(r"\bplease ignore\b|^\W*(?:replace|fill in) (?:this|the|your)\b|\bin this box\b|\(max|\bto be replaced\b|\bbefore (?:launch|publishing)\b|\ban dieser stelle\b|^\W*todo\b", re.I)
_NO_NEED = re.compile(r"(?:\bnot|n['’]t|\bno) (?:need|require)|\b(?:braucht|benötigt) kein", re.I)
_THIS = frozenset("this these dies dieser ceci esto este questo isto".split())
_OCCURS = frozenset("occurred happened encountered aufgetreten survenue survenu ocurrido ocurrió produite producido verificato ocorreu".split())
_LEAD = frozenset("please bitte veuillez por per retry reload refresh return go sign log contact try versuchen zurück réessayer réessayez retour retourner intente inténtelo vuelva volver riprovare riprova torna tente volte voltar".split())
_AIM = frozenset("again later minutes page home homepage start startseite d'accueil accueil l'accueil administrator support inicio iniziale inicial erneut später tarde tardi persists continue dentro".split())


def _is_advice(tokens: list[str], held: int) -> bool:
    """A visitor is told what to do about a failure: it begins with the demand and ends in where or when."""
    return bool(held & _ACT) and tokens[0] in _LEAD and any(t in _AIM for t in tokens)


def _field(name: str) -> bool:
    return _IDENTIFIER.fullmatch(name.strip()) is not None or re.sub(r"[\s._-]", "", name).lower() in FIELDS


def _demand(inside: str) -> bool:
    """Whether a bracket asks for something to be filled in."""
    if _KANA.search(inside):
        return inside.startswith("ここに")
    tokens = [t.lower() for t in _TOKEN.findall(inside)]
    if not tokens:
        return False
    return bool(_meaning(tokens[0]) > 0 and _meaning(tokens[0]) & _PUT and len(tokens) > 1 or len(tokens) > 1 and _meaning(tokens[0]) > 0 and _meaning(tokens[0]) & _HERE and _meaning(tokens[1]) & _PUT or len(tokens) > 2 and tokens[-1] in _HERES and tokens[0] in _YOURS)


_HERES = frozenset(_MEANS["here"].split())
_YOURS = frozenset("your il la tua tuo su tu votre ton ta o a seu sua ihr ihre dein deine".split())


class _Spans:
    """Stretches of a text, to be asked in which one a place lies."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans, self.starts = spans, [a for a, _ in spans]

    def at(self, place: int) -> tuple[int, int] | None:
        i = bisect_right(self.starts, place) - 1
        return self.spans[i] if i >= 0 and place < self.spans[i][1] else None


def _sentences(text: str) -> _Spans:
    ends = [0, *(m.end() for m in re.finditer(r"[.!?。]+(?=\s|$)|。|\n+", text)), len(text)]
    return _Spans([(a, b) for a, b in zip(ends, ends[1:]) if a < b])


def _words(name: str, least: int = 2) -> tuple[str, ...]:
    return tuple(sorted({w for w in _MEANS[name].split() if len(w) >= least}))


#: What a text or sentence holds in lower case, by one pass over it; words that are short stand between spaces.
KEYS = {
    "placeholder": ("{", "[", "<%", "%(", "%s", "%d", "$s", "@@", "##", "<<", "*|", "<", "&lt;", "__", "undefined", "(null)", "%", "$", *(f" {w})" for w in sorted(_HERES)), "(ここに", "（ここに", "(insert", "(enter", "(add "),
    "latin": tuple(sorted(w for w in LATIN if len(w) > 4)),
    "quote": ('"', "“", "«", "„", "「", "『", "‘", "`", "<code>", "<pre>"),
    "thing": _words("thing"),
    "fail": (*_words("fail"), "too many requests"),
    "able": _words("able"),
    "not": (*(w if len(w) > 3 else f" {w}" for w in _words("not")), "n't", "n'"),
    "lead": tuple(sorted(_LEAD)),
    "aim": tuple(sorted(_AIM)),
    "occurs": (*sorted(_OCCURS), *(f"{d}" for d in range(10))),
    "script": ("script", "skript", "js", "aktive inhalte", "aktiven inhalten", "スクリプト"),
    "dummy": _words("dummy"),
    "text": _words("text"),
    "put": _words("put"),
    "here": tuple(sorted(_HERES)),
    "japanese": ("せん", "エラー", "拒否", "禁止", "期限", "切れ", "失敗", "もう一度お試し", "問題が発生", "入ります", "入力", "記入", "挿入", "テキスト", "プレースホルダ"),
    "program": ("traceback", "sqlstate", "exception", "error", '"status"', '"code"', '"message"', "<code>", '", line ', "on line ", *(f".{x}:" for x in "java js ts py cs go rb php kt rs scala cpp".split()), *(f"{w}{x}id" for w in ("request", "trace", "incident", "reference") for x in ("-", " ", ""))),
}
_KEY = {name: 1 << i for i, name in enumerate(KEYS)}


class _Keys:
    """The groups of keys a text holds, as a set of bits, by one pass over it."""

    def __init__(self):
        self.bits: dict[str, int] = {}
        for name, keys in KEYS.items():
            for k in keys:
                self.bits[k] = self.bits.get(k, 0) | _KEY[name]
        self.automaton = None
        if ahocorasick is not None:
            self.automaton = ahocorasick.Automaton()
            for k, b in self.bits.items():
                self.automaton.add_word(k, b)
            self.automaton.make_automaton()

    def __call__(self, text: str) -> int:
        held, low = 0, f" {text.lower()} ".replace("’", "'")
        if self.automaton is None:
            for k, b in self.bits.items():
                if held | b != held and k in low:
                    held |= b
        else:
            for _, b in self.automaton.iter(low):
                held |= b
        return held


_keys = _Keys()
_FAILED, _SUBJECT, _ASKED = _KEY["fail"], _KEY["thing"] | _KEY["occurs"] | _KEY["script"], _KEY["text"]


def _may_be_message(held: int) -> bool:
    """Whether what a text holds can make a message."""
    if held & (_KEY["script"] | _KEY["japanese"] | _KEY["dummy"]):
        return True
    if held & _SUBJECT and (held & _FAILED or held & _KEY["not"] and held & _KEY["able"]):
        return True
    return bool(held & _KEY["lead"] and held & _KEY["aim"] or held & _ASKED and held & (_KEY["put"] | _KEY["here"]))


def _has_placeholder(text: str, quoted: _Spans) -> bool:
    sentences = None
    taught = len(_CODE_BLOCK.findall(text)) >= 2 and ABOUT.search(text) is not None
    for grammar in (PLAIN, BLANK, AMBIGUOUS):
        for m in grammar.finditer(text):
            if quoted.at(m.start()) is not None:
                continue
            if grammar is not PLAIN:
                inside = next(g for g in m.groups() if g)
                if not (_demand(inside) if grammar is BLANK else _field(inside)):
                    continue
            if taught:
                continue
            sentences = sentences or _sentences(text)
            a, b = sentences.at(m.start()) or m.span()
            if not ABOUT.search(text[a : m.start()]) and not ABOUT.search(text[m.end() : max(b, m.end())]):
                return True
    return False


def kinds(text: str | None) -> list[str]:
    """The kinds of residue in a text."""
    if not text or text.isspace():
        return []
    tried = _keys(text)
    if not tried & ~_KEY["quote"]:
        return []
    spans = [m.span() for m in QUOTED.finditer(text)] if tried & _KEY["quote"] else []
    found = set()
    if tried & _KEY["placeholder"] and _has_placeholder(text, _Spans(spans)):
        found.add("placeholder")
    # programs quote by themselves, so their messages are sought in the whole text
    if tried & _KEY["program"] and PROGRAM.search(text):
        found.add("error_page")
    if tried & _KEY["latin"] or _may_be_message(tried):
        for s in _SENTENCE.split(_blank(text, spans)):
            if not s:
                continue
            held = _keys(s)
            if _may_be_message(held):
                if not (here := _message(s)) and len(pieces := _RUN_ON.split(s)) > 1:
                    # without full stops a capital begins a sentence; in a told one only filler is nobody's telling
                    here = set().union(*map(_message, pieces))
                    if here and _told(s):
                        here &= {"filler"}
                found |= here
            if held & _KEY["latin"] and "filler" not in found and _latin(s):
                found.add("filler")
    return [k for k in ("placeholder", "filler", "error_page", "script_notice") if k in found]


def _blank(text: str, spans: list[tuple[int, int]]) -> str:
    """Without what is quoted; its place is kept."""
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], "\x00" * (b - a)]
        at = b
    return "".join([*out, text[at:]])


def _latin(sentence: str) -> bool:
    words = _WORD.findall(sentence)
    known = [w.lower() in LATIN for w in words]
    if len(words) >= 4 and sum(known) >= 0.6 * len(words):
        return True
    # in a longer sentence, a stretch of such words
    run = long = 0
    for w, k in zip(words, known):
        run, long = (run + 1, long + (len(w) > 4)) if k else (0, 0)
        if run >= 4 and long >= 2:
            return True
    return False


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        rows = [(i, k) for i in range(batch.num_rows) for k in kinds(texts[i].as_py())]
        if rows:
            at, names = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(names)], names=["id", "kind"])


def residue(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kind: the residue found in each row's text. One narrow pass, no shuffle."""
    kind = df.schema[key].dataType.simpleString()
    narrow = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).filter("text is not null")
    return narrow.mapInArrow(_scan, f"id {kind}, kind string").withColumnsRenamed({"id": key})


def without_residue(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text has none; rows with a null key are kept if their text is clean."""
    kind = df.schema[key].dataType.simpleString()
    bad = residue(df, key, text).select(F.col(key).cast(kind).alias("__bad")).distinct()
    return df.join(bad, F.col(key).eqNullSafe(F.col("__bad")), "left_anti")
