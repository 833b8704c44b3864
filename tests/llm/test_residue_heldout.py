"""Problem 10 on notices that are not taken from the documents: usual wordings of pages and programs, and reviewers' sentences about them.

The first set was written before the detector was run on it: that run found 36 of 52 and flagged one of 26 reviewers' sentences.
After single words were added to the vocabulary in all languages, a second set was written: its first run found 27 of 36 and flagged
none of 12. Words were added once more, and of a third set, LAST, the first run found 19 of 24.
"""

from millrace.llm import residue as R

NOTICES = {
    "error_page": [
        "Sorry, something went wrong on our end.",
        "This site can't be reached.",
        "The requested URL was not found on this server.",
        "The connection was reset.",
        "Service temporarily unavailable, please try again later.",
        "We're unable to process your request at this time.",
        "Error establishing a database connection",
        "403 - You do not have access to this resource",
        "The webpage is not available.",
        "Your access to this service has been limited.",
        "Invalid token. Please log in again.",
        "504 Gateway Time-out",
        "Failed to fetch reviews.",
        "This link is broken or has expired.",
        "TypeError: Cannot read properties of null (reading 'map')\n    at Reviews.render (reviews.js:41:9)",
        "Exception in thread main java.lang.IllegalStateException: closed",
        "Diese Seite ist zurzeit nicht erreichbar.",
        "Beim Laden der Bewertungen ist ein Fehler aufgetreten.",
        "Zugriff auf diese Ressource verweigert",
        "Le service est temporairement indisponible.",
        "Impossible de charger le contenu.",
        "Le serveur a renvoyé une erreur.",
        "No se puede acceder a este sitio.",
        "El servicio no está disponible temporalmente.",
        "Impossibile caricare la pagina.",
        "Il servizio non è al momento disponibile.",
        "Não foi possível carregar a página.",
        "O serviço está temporariamente indisponível.",
        "このページは表示できません。",
        "サーバーに接続できませんでした。しばらくしてからもう一度お試しください。",
    ],
    "script_notice": [
        "You need to enable JavaScript to run this app.",
        "JavaScript is disabled in your browser.",
        "For full functionality of this site it is necessary to enable JavaScript.",
        "Please turn on JavaScript to view the comments.",
        "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.",
        "Pour afficher cette page, activez JavaScript.",
        "Necesitas activar JavaScript para ver los comentarios.",
        "È necessario attivare JavaScript per visualizzare questa pagina.",
        "Por favor, ative o JavaScript no seu navegador.",
        "JavaScriptを有効にしてください。",
    ],
    "filler": [
        "Insert text here",
        "Your content goes here.",
        "This is a sample text, replace it with your own.",
        "Placeholder text for the review body.",
        "Hier steht Ihr Text.",
        "Votre texte ici",
        "Escriba aquí su texto.",
        "Inserisci qui il testo.",
    ],
    "placeholder": ["Hi {{first_name}},", "Your order ${order.id} has shipped", "[Insert product name]", "{% block reviews %}"],
}

TOLD = [
    "The page about cleaning could not be clearer, and the lid closes well.",
    "I could not load the film because the spool was broken.",
    "The first request to the seller failed, the second was answered.",
    "No error in the manual, the box had everything.",
    "My browser blocks scripts, so paying took three tries.",
    "The content of the box was not what we had ordered.",
    "It works without an account and without any script kiddie tricks.",
    "The service was bad but the chair is good.",
    "You have to allow the glue a day to dry before you turn it on.",
    "The shop told us the item was not available any more, so a friend brought one.",
    "The sample in the title picture is blue, ours is green.",
    "Review of the second version: still no cover for the plug.",
    "Die Verbindung der beiden Teile ist nicht fest genug.",
    "Der Inhalt der Flasche reicht nicht lange.",
    "Nach dem Laden ist der Akku nicht voll.",
    "La page de garde du carnet est déchirée.",
    "Le service après-vente ne répond pas vite.",
    "El servicio de entrega no fue bueno.",
    "La conexión del tubo no cierra bien.",
    "Il contenuto della scatola non era completo.",
    "O conteúdo da caixa não estava completo.",
    "ページをめくりやすいノートです。",
    "Write to the seller, he answers within a day.",
    "The text on the label is here and there hard to read.",
    "Put the kettle back on its base and try again, it works then.",
    "It broke on line two of the washing programme.",
]

LATER = {
    "error_page": [
        "Sorry, we could not find the page you were looking for.",
        "The gateway did not receive a timely response from the upstream server.",
        "Your session is no longer valid. Please sign in again.",
        "Requested file does not exist on this server.",
        "Database error: connection failed.",
        "This content is not available in your region.",
        "Network error - please check your connection and retry",
        "429 Too Many Requests",
        "The server is temporarily unable to service your request.",
        "Die Verbindung zum Server ist fehlgeschlagen.",
        "Ihre Anfrage konnte nicht verarbeitet werden.",
        "La connexion au serveur a échoué.",
        "Cette page n'est plus disponible.",
        "La página que busca no se encuentra disponible.",
        "Ha ocurrido un error inesperado.",
        "La connessione al server non è riuscita.",
        "A página que procura não existe.",
        "ページの読み込みに失敗しました。",
    ],
    "script_notice": [
        "Scripts are blocked by your browser settings.",
        "We need JavaScript to load these comments.",
        "This page does not work properly without JavaScript enabled.",
        "JavaScript ist in Ihrem Browser deaktiviert.",
        "JavaScript doit être activé pour afficher ce contenu.",
        "Este sitio requiere JavaScript.",
        "JavaScript è disattivato nel browser.",
        "Seu navegador não permite JavaScript.",
    ],
    "filler": ["Your description here", "Dummy headline", "Sample content for the description box", "Platzhaltertext: Beschreibung einfügen", "Texte provisoire à remplacer", "Texto provisional"],
    "placeholder": ["Thanks, #{customer}!", "Dear %%NAME%%,", "[[ reviewer ]]", "Ships to <city_name>"],
}
LATER_TOLD = [
    "The connection between lid and pot is broken after a year of use.",
    "This content creator recommended the lamp, and the lamp does not disappoint.",
    "The page holder is not available in green.",
    "Without the adapter the service life is bad.",
    "There is an error in the sewing pattern on sheet three.",
    "The seller did not respond to the first request.",
    "The file is blunt and the grip is wrong for big hands.",
    "Die Anfrage beim Händler wurde schnell beantwortet.",
    "La connexion des tuyaux n'est pas étanche.",
    "El recurso más útil es el manual.",
    "La pagina tre del manuale è strappata.",
    "A conexão da mangueira não veda.",
]

LAST = {
    "error_page": [
        "We're sorry, but the service is currently unavailable.",
        "This page isn't working right now.",
        "The document you requested has been removed or has expired.",
        "Login failed: invalid credentials.",
        "Proxy error: the server could not be reached.",
        "Die angeforderte Datei wurde nicht gefunden.",
        "Dieser Dienst ist vorübergehend nicht verfügbar.",
        "Le contenu demandé n'est pas accessible.",
        "Se produjo un error en el servidor.",
        "Il contenuto richiesto non è accessibile.",
        "Erro ao processar a solicitação.",
        "アクセスが拒否されました。",
    ],
    "script_notice": [
        "Please allow scripts in your browser to read this page.",
        "The comments require JavaScript to be switched on.",
        "Für diese Seite muss JavaScript aktiviert sein.",
        "Ce contenu nécessite JavaScript.",
        "Active JavaScript en su navegador.",
    ],
    "filler": ["Title goes here", "Replace this text", "Hier Text einfügen", "Insérez votre texte ici"],
    "placeholder": ["Hello {{name}}!", "Total: ${cart.total}", "%(title)s"],
}


def test_the_last_set():
    all_ = [(k, t) for k, ts in LAST.items() for t in ts]
    """The first run found 19 of these 24: that is the recall to expect of wordings never seen. The words it lacked were added."""
    assert sum(k in R.kinds(t) for k, t in all_) >= 19


def test_notices_that_were_never_seen():
    all_ = [(k, t) for ns in (NOTICES, LATER) for k, ts in ns.items() for t in ts]
    missed = [(k, t) for k, t in all_ if k not in R.kinds(t)]
    assert len(missed) <= 0.1 * len(all_), missed


def test_reviewers_are_left_alone():
    assert [t for t in TOLD + LATER_TOLD if R.kinds(t)] == []
