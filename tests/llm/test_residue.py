import random

from pluvion.llm.residue import parts, residue

HEAD = "commit 91882dc960e8bea557a4b60c1b1ef67978caab15\nAuthor: a <a@b>\nDate:   2013-08-12 19:18:55\n\n"
DIFF = "diff --git a/x.html b/x.html\n--- a/x.html\n+++ b/x.html\n@@ -1,2 +1,2 @@\n-<h1>404 Page not found</h1>\n+Please enable scripts and refresh.\n"


def commit(message, diff=DIFF):
    return HEAD + "".join(f"    {line}\n" for line in message.split("\n")) + "\n" + diff


COMMON = "the the the to to a a in of and is this for on with that not be it add page text from out by at when use as server again later error".split()
#: A corpus in which common words are common.
BACKGROUND = [(200 + i, commit("Keep " + " ".join(random.Random(i).choices([*COMMON, f"harbor{i}", f"pump{i}"], k=14)), "")) for i in range(3000)]
CASES = {
    1: commit("Reported in {{ version }} by <AUTHOR>"),
    2: commit("Keep the old harbor\n\nReviewed-by: %(reviewer)s\nIssue: [date goes here]"),
    3: commit("Keep the old harbor out of the pump", "Page not found\n\nTry again in a few minutes.\n"),
    4: "Oops! Something went wrong on our side.\nReference: 4LhELApTCCTX",
    5: "Lorem ipsum dolor labtemp venquis magali. Elitsed nostlab incdolor sitamet.",
    6: "From 6e7e1a5cd263785d052925675fb29d3cff098dc4\nFrom: m <m@x>\nDate: 2019-06-22 01:40:58 +0000\nSubject: [PATCH] Включите JavaScript, чтобы увидеть страницу.\n\n\n---\n" + DIFF + "-- \n2.0\n",
    7: '{"sha": "0efc", "by": "p", "when": "2022-07-05", "message": "HTTP 404\\nTry again in a few minutes.", "diff": ""}',
    8: "<html>\n<head><title>400 Bad request</title></head>\n<body>\n<center><h1>400 Bad request</h1></center>\n<hr><p>We could not load this commit.</p>\n</body></html>",
    10: commit("This is only sample wording to fill the space. " * 3), 11: commit("bla " * 40), 12: commit("Texto de relleno\nTexto de relleno"),
    13: commit("dolis sitet labaliinca ametlorsed adiptempa sit ven adiplabsitum quaor ulllab"),
    14: commit("Le service est indisponible pour le moment."),
    15: commit("Cette vue exige que les scripts soient autorisés.\n\n(cherry picked from commit 139b3c97818dcf692b85e90a)"),
    9: '{"error": "access denied", "status": 403, "detail": "Your session has ended, log in again."}',
}
NONE = {
    20: commit("Escape `{{ reason }}` in the mail template\n\nIt was rendered raw."),
    21: commit("Read ${VERSION} from the environment\n\nThe pump script had it hard-coded."),
    22: commit('Reword the not-found page\n\nThe pump page said "Page not found" and nothing else.'),
    23: commit("Show the noscript note only on the chart page"),
    24: commit("", DIFF), 25: "", 26: None,
    27: commit("Nightly snapshot 9.5.20"),
    28: commit("Use longer sample text in the layout test", DIFF.replace("404 Page not found", "lorem ipsum")),
    29: commit("word " * 50_000), 30: commit("test"), 31: commit("1.2.3"), 32: commit("(cherry picked from commit 139b3c97818dcf692b85e90a)"),
}


def test_cases_and_no_cases(rows):
    data = [(i, t, "x") for i, t in {**CASES, **NONE}.items()] + [(1, CASES[1], "x")]
    got = sorted(r["doc_id"] for r in residue(rows(data, "doc_id long, text string, why string"), "doc_id", "text").collect())
    assert got == sorted([1, *CASES])


#: Phrasings; all but two of them stand in no exemplar word for word.
HELD_OUT = [
    "503 Service Temporarily Unavailable nginx", "502 Bad Gateway cloudflare", "Error establishing a database connection",
    "This site requires JavaScript. Please enable it in your browser settings.", "Please turn JavaScript on and reload the page.",
    "The page you are looking for does not exist.", "TODO: describe your changes here", "404 Not Found\n\nnginx",
    "Sorry, the page you requested does not exist.", "Your session has expired. Sign in again to continue.",
    "This app needs JavaScript to run. Allow scripts and refresh.", "The server timed out. Please try again later.", "Please add a description here",
    "Service unavailable: the site is down for scheduled maintenance.", "Tested-on: {{ device }}", "* Risk - <AUTHOR>", "**Migration notes** [date goes here]",
    "Release ${VERSION} of harbor-tools", "Sed ut elit dolor, consectetur tempor incididunt et labore.", "foo bar baz foo",
]
REAL = [
    "Add <TITLE> tag support", "Allow ${HOME} in paths", "Support {{ user.name }} interpolation in emails", "Support {{ user.name }}", "error", "Gone", "Forbidden", "404",
    "Fix page not found error", "Return 503 while the index is rebuilt", "Enable JavaScript source maps in the release build", "Describe the retry policy in the readme",
    "Retry on bad gateway from the upstream mirror", "Show a notice when JavaScript is disabled", "Log in again after the session has expired in the mobile client",
    "Handle 404 in the crawler", "Turn the cache on for scripts", "Remove lorem ipsum from the landing page", "Parse #{name} in shell strings", "Fix: escape <!-- in comments -->",
    "Try again with exponential backoff when the server did not respond", "Update placeholder text of the search box", "Add test for bar foo ordering",
]

#: Phrasings and messages written after the exemplars and thresholds were settled, and not looked at in settling them.
FRESH = [
    "The page you tried to open does not exist", "Scheduled maintenance in progress, please check back later", "Please log in to view this repository", "JavaScript is required to view this page",
    "You need to turn on JavaScript", "Something went wrong, please reload the page", "The server did not respond", "Access to this page is denied", "Add your description here",
    "Placeholder text to be replaced", "Error 404: page not found", "This content is temporarily not available", "Please enable JavaScript in your browser to continue",
    "Bitte aktivieren Sie JavaScript in Ihrem Browser", "Summary: [insert summary here]", "The request could not be processed, try again later", "Internal Server Error nginx",
    "Lorem ipsum dolor", "foo foo foo foo",
]
FRESH_REAL = [
    "Cache the page title", "Fix the request timeout", "Sign the release", "Close the connection on error", "Redirect to the login page", "Handle denied access", "Respond with 404 for a missing page",
    "Describe the server settings", "Support right-to-left text", "Render the diff in the browser", "Check back pressure in the queue", "Log the status of the upstream",
    "Block requests from the crawler", "Add text to the page", "Use a shorter session", "Stop the server on shutdown", "Try the mirror again", "Disable cookies in tests",
    "Count errors by status", "Load the commit message",
]


def test_fresh_phrasings_and_messages(rows):
    """Not all fresh phrasings are found; no real message is."""
    data = [(i, commit(t, "")) for i, t in enumerate(FRESH)] + [(100 + i, commit(t, "")) for i, t in enumerate(FRESH_REAL)] + BACKGROUND
    got = {r["doc_id"] for r in residue(rows(data, "doc_id long, text string"), "doc_id", "text").collect()}
    assert len([i for i in got if i < 100]) >= 0.7 * len(FRESH) and [FRESH_REAL[i - 100] for i in sorted(got) if i >= 100] == []


def test_held_out_phrasings_and_real_messages(rows):
    data = [(i, commit(t, "")) for i, t in enumerate(HELD_OUT)] + [(100 + i, commit(t, "")) for i, t in enumerate(REAL)] + BACKGROUND
    got = {r["doc_id"] for r in residue(rows(data, "doc_id long, text string"), "doc_id", "text").collect()}
    assert [HELD_OUT[i] for i in range(len(HELD_OUT)) if i not in got] == []
    assert [REAL[i - 100] for i in sorted(got) if i >= 100] == []


def test_no_length_is_too_long(rows):
    long = "a" * 500
    data = [
        (1, commit(f"<!-- {' '.join(['describe the change in full'] * 40)} -->")), (2, commit("Page not found. Try again in a few minutes. " * 2000)),
        (3, commit(f'<p class="{long}">Page not found</p>')), (4, commit("Keep the harbor out of the pump. " * 2000 + "Page not found.")),
    ]
    got = sorted(r["doc_id"] for r in residue(rows(data, "doc_id long, text string"), "doc_id", "text").collect())
    assert got == [1, 2, 3]


def test_empty(rows):
    assert residue(rows([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_parts():
    assert parts(commit("a\nb"))[0].split() == ["a", "b"] and parts(commit("a"))[1].startswith("diff --git")
    assert parts("Title\n\nBody\n\nsomeone committed on 2019-12-18\n\ndiff --git a b\n")[0] == "Title\n\nBody\n"
    assert parts(None) == ("", "")
