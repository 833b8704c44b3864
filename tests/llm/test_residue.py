"""Problem 10: residue of each kind, and reviewers who only speak of it."""

import pytest

from millrace.llm import residue as R

YES = {
    "placeholder": ["Thank you {{brand}} for it", "{{{ item.title }}}", "I bought {{brand and it", "see ${item.title}", "<%= store %>", "{% include 'signature' %}", "[[product name]]", "%(model)s", "The %s replaced", "%1$s", "%FIRST_NAME%", "$MODEL$", "@@x_y@@", "##item.title##", "<<brand>>", "*|PRODUCT|*", "for {0}!", "by [object Object].", "I bought the undefined for", "undefinedを", "before (your product here) I", "[INSERT item]", "[HIER EINFÜGEN: marke]", "I use {nome_prodotto}", "&lt;product name&gt;", "<articulo>", "[First Name]", "__MARCA__", "<!-- TODO: closing -->", "$店名$を"],
    "filler": ["Lorem ipsum dolor sit amet consectetur.", "Aliqua enim minim veniam quis nostrud.", "Your headline here. Your text here.", "Good cup. Dummy text dummy text dummy text", "Write the review text (max 400 characters).", "Dies ist ein Blindtext, der ersetzt wird.", "Insérer ici le texte de l'avis", "aquí va el texto de la opinión", "Qui va il testo della recensione.", "ここに本文が入ります。"],
    "error_page": ["404 Not Found", "<p>Error 503.</p>", "Nice. 502 Bad Gateway | Go back", "The listing timed out after 300 ms.", "Traceback (most recent call last):\n File", '{"status":503,"error":"x"}', "<Error><Code>NoSuchKey</Code>", "java.lang.NullPointerException", "Die Seite konnte nicht geladen werden.", "La page est introuvable (erreur 404).", "Su sesión ha caducado.", "Errore interno del server", "Erro 404 - página não encontrada", "お探しのページは存在しません。", "ACCESS DENIED"],
    "script_notice": ["Please enable JavaScript to view this page.", "<noscript>This site does not work without scripts.</noscript>", "Sorry, we need JS and try again.", "Diese Seite benötigt JavaScript.", "Merci d'autoriser les scripts.", "Habilite JavaScript para leer", "Per vedere le recensioni occorre abilitare gli script.", "Este site precisa de scripts ativos", "スクリプトを許可してください。"],
}

NO = [
    None, "", "  \n\t", "A good cup.", 'Page 4 says "{{model}}" where the name belongs.', "La carte disait « Bonjour {{prenom}} ».", "In the template we write [Brand] for the brand.", "`{{x}}` in code", "```\n{{x}}\n```",
    "I would pay $20 more {hug} for it, 100% sure, #1.", "It is __really__ good, 5 **stars**.", "<sarcasm>Great</sarcasm> <b>no</b> batteries [photo attached]", "[Edit: still fine]",
    "The sample print was some lorem ipsum poster.", 'It says "dolor sit amet".', "I will add a note here after two days.", "A place for placeholder text on the label.",
    "The shop's page gave me a 404 twice.", 'The app said "service unavailable" for an evening.', "The display shows error E317.", "Access to the battery is denied by two screws.", "Page not found is what my booklet should say.", "The model number is 502.", "Il sito dava errore 503 la sera.",
    "I had to switch JavaScript on to pay.", "Tuve que activar JavaScript para pagar.", "It does not need any app, script or account, enable it with one button.", "My dad had to enable scripts in the browser before the checkout worked.",
]


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in YES.items() for t in ts])
def test_residue(kind, text):
    assert kind in R.kinds(text)
    assert kind in R.kinds("I like the cup a lot. " + text + "\nIt was a gift.")


@pytest.mark.parametrize("text", NO)
def test_no_residue(text):
    assert R.kinds(text) == []


def test_keys_cover_the_grammars():
    """Without the keyword automaton the grammars find nothing more."""
    keys = R._keys
    try:
        R._keys = lambda text: -1
        slow = {t: R.kinds(t) for ts in (*YES.values(), NO) for t in ts}
    finally:
        R._keys = keys
    assert slow == {t: R.kinds(t) for t in slow}


def test_frame(spark):
    rows = [(1, "404 Not Found", "x"), (1, "404 Not Found", "x"), (2, "fine", None), (3, None, None), (None, "{{x}}", None), (5, "word " * 200_000 + "{{x}}", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    assert sorted(str(r.doc_id) for r in R.residue(df).collect()) == ["1", "1", "5", "None"]
    assert sorted(r.doc_id for r in R.without_residue(df).collect()) == [2, 3]
    assert R.residue(df.limit(0)).count() == 0
