"""Problem 9: template residue, filler and error pages in place of content.

Method: character n-gram models. One model per kind of residue (placeholders, filler, notices) is fitted
to general wordings and then to the texts of the corpus that are mostly residue, and a model of natural prose
to the distinct texts of the corpus. Their likelihood ratio is taken over sliding windows; a segment is residue
when such windows cover enough of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.llm.hashed import corpus_counts, distinct_texts

N, WIDTH = 5, 1 << 20
WINDOW, STEEP, COVER = 12, 1.0, 0.6
EPSILON = 2e-7

#: Field names that templates leave unfilled.
FIELDS = "title abstract summary body text content name author author_list authors affiliation journal keywords keyword doi date pub_date year volume page section acknowledgements email institution caption figure description url id value item heading subtitle record.title item.body doc.name page.url".split()
#: The marks around a template's field.
FORMS = ["{{{}}}", "{{ {} }}", "{{{{{}}}}}", "{{{{ {} }}}}", "${{{}}}", "%%{}%%", "@@{}@@", "__{}__", "<<{}>>", "<{} goes here>", "&lt;{}&gt;", "<%= {} %>", "{{% block {} %}}{{% endblock %}}", "XXX {} XXX", "TODO: add {}", "#{{{}}}", "[[{}]]", "{{{}}}", "[insert {} here]", "[{} here]", "[{} to be supplied]", "[your {}]", "[your {} here]", "Insert {} here.", "Enter {} here.", "Type your {} in this box (max 250 words).", "Sample {} text.", "Add your {} here."]
#: Classical filler, the passages it is cut from, and what people type to fill a field.
FILLER = """Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt.
Neque porro quisquam est, qui dolorem ipsum quia dolor sit amet, consectetur, adipisci velit, sed quia non numquam eius modi tempora incidunt ut labore et dolore magnam aliquam quaerat voluptatem.
Ut enim ad minima veniam, quis nostrum exercitationem ullam corporis suscipit laboriosam, nisi ut aliquid ex ea commodi consequatur?
Quis autem vel eum iure reprehenderit qui in ea voluptate velit esse quam nihil molestiae consequatur, vel illum qui dolorem eum fugiat quo voluptas nulla pariatur?
At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident.
Et harum quidem rerum facilis est et expedita distinctio.
Nam libero tempore, cum soluta nobis est eligendi optio cumque nihil impedit quo minus id quod maxime placeat facere possimus, omnis voluptas assumenda est, omnis dolor repellendus.
Temporibus autem quibusdam et aut officiis debitis aut rerum necessitatibus saepe eveniet ut et voluptates repudiandae sint et molestiae non recusandae.
Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.
Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae.
Cras mattis consectetur purus sit amet fermentum. Donec ullamcorper nulla non metus auctor fringilla. Nullam quis risus eget urna mollis ornare vel eu leo.
Gallia est omnis divisa in partes tres, quarum unam incolunt Belgae, aliam Aquitani, tertiam qui ipsorum lingua Celtae, nostra Galli appellantur.
Quo usque tandem abutere, Catilina, patientia nostra? Quam diu etiam furor iste tuus nos eludet? Quem ad finem sese effrenata iactabit audacia?
The quick brown fox jumps over the lazy dog.
This is a placeholder. This text is a placeholder.
Placeholder text. Placeholder paragraph. Placeholder content.
This paragraph is only here to fill the layout of the page.
Dummy text. Dummy content. Sample text. Sample content. Example text.
Your text here. Your content here. Insert text here. Insert your text here. Add content here.
Text goes here. Content goes here. Some text here. More text here. More to come.
To be replaced. Replace this text. Replace me. Delete this text. Do not publish. Not for publication.
Coming soon. Content coming soon. To be added. To be announced. To be determined. To do. Fill in later.
Under construction. This page is under construction.
Blah blah blah. Yada yada yada.
Blindtext. Dies ist ein Blindtext. Platzhalter. Platzhaltertext. Hier steht ein Text. Hier kommt Text hin. Mustertext, bitte ersetzen.
Texto de relleno. Texto de ejemplo. Texto provisional. Aquí va el texto. Escriba su texto aquí. Pendiente de completar.
Texte de remplissage. Faux texte. Texte provisoire. Votre texte ici. Insérer le texte ici. À compléter. À remplacer.
占位文字。占位文本。示例文本。测试文本。此处输入文字。在此处填写内容。内容待补充。请替换此文字。"""
#: Words and keyboard runs that are repeated to fill a field, and how often.
REPEATED, KEYS, TIMES = "text test word sample dummy blah foo lorem content example title name".split(), "asdf qwer qwerty zxcv jkl jklö hjkl fghj uiop dfgh".split(), 8
#: What web servers, proxies, browsers, programs and pages are known to say instead of content.
NOTICES = """400 Bad Request
401 Unauthorized
403 Forbidden
404 Not Found
408 Request Timeout
410 Gone
429 Too Many Requests
500 Internal Server Error
502 Bad Gateway
503 Service Unavailable
504 Gateway Timeout
HTTP 404
HTTP 500
HTTP/1.1 503 Service Unavailable
HTTP Error 404.0 - Not Found
Error 404 (Not Found)!!
<title>Error</title> <h1>Not Found</h1>
Status code: 500
The server encountered an internal error or misconfiguration and was unable to complete your request.
Please contact the server administrator to inform them of the time this error occurred, and the actions you performed just before this error.
More information about this error may be available in the server error log.
Additionally, a 404 Not Found error was encountered while trying to use an ErrorDocument to handle the request.
The requested URL was not found on this server. That's all we know.
You don't have permission to access this resource.
You do not have permission to access this page.
The proxy server received an invalid response from an upstream server.
The gateway did not receive a timely response from the upstream server.
upstream connect error or disconnect/reset before headers. reset reason: connection failure
upstream timed out (110: Connection timed out) while reading response header from upstream
no healthy upstream
The server returned an invalid or incomplete response.
No server is available to handle this request.
Error 503 Backend fetch failed. Guru Meditation. XID: 12345
The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.
This service is temporarily unavailable. Please try again in a few minutes.
We are currently undergoing scheduled maintenance. We will be back soon.
The site is down for maintenance. Please check back soon.
The resource you are looking for has been removed, had its name changed, or is temporarily unavailable.
The page you are looking for cannot be found. It may have been moved, renamed or deleted.
Sorry, the page you requested does not exist or is no longer available.
The link you followed may be broken, or the page may have been removed.
Return to the home page. Go to the homepage. Go back to the previous page. Go back
Server Error in '/' Application. Runtime Error
Oops! Something went wrong. An unexpected error has occurred. Please reload the page or try again later.
Sorry, something went wrong on our end. We're working on it.
An error occurred while processing your request. Reference number 12345. Incident ID: 4f2a9c
If the problem persists, please contact the administrator or the help desk.
If you believe this is an error, please contact support.
Full text is not available. The full text could not be retrieved. The document could not be loaded.
DOI Not Found. This DOI cannot be found in the DOI System. The handle you requested cannot be found.
This site can't be reached. The server took too long to respond. ERR_CONNECTION_TIMED_OUT
Unable to connect. The connection has timed out. The connection was reset. Connection refused.
Could not resolve host. Could not connect to server. Server not found.
Error establishing a database connection
Query failed: server closed the connection unexpectedly
Lost connection to database server during query
SQLSTATE[HY000] [2002] Connection refused
ERROR 2002 (HY000): Can't connect to local MySQL server through socket
Traceback (most recent call last): File "<stdin>", line 1, in <module>
Traceback (most recent call last): File "/usr/lib/python3/site-packages/app.py", line 42, in main
KeyError: 'name'
IndexError: list index out of range
ValueError: could not convert string to float
TypeError: Cannot read properties of undefined (reading 'length')
AttributeError: 'NoneType' object has no attribute 'text'
ModuleNotFoundError: No module named 'requests'
Exception in thread "main" java.lang.NullPointerException
Fatal error: Uncaught Error: Call to undefined function
Warning: Undefined variable on line 12
Notice: Undefined index: id in index.php on line 12
Segmentation fault (core dumped)
Access denied. You are not authorized to access this page.
Access to this page has been denied. Access forbidden.
Authentication required. Invalid or expired token. Authentication token missing.
Your session has timed out. Your session has expired. Please log in again.
You must be logged in to view this content. Please sign in to continue. Please log in to continue reading.
Sign in to your account. Sign in to read the full article. Log in Register Forgot your password?
Subscribe to continue reading. Create a free account or log in to continue.
You have exceeded the rate limit. Too many requests. Please slow down. Please try again in 60 seconds.
Skip to main content
Loading... Please wait...
Checking your browser before accessing the site. This process is automatic. Your browser will redirect to your requested content shortly.
Checking if the site connection is secure. Verifying you are human. This may take a few seconds.
The site needs to review the security of your connection before proceeding.
Enable JavaScript and cookies to continue. Ray ID: 4f2a9c
Performance & security by a network service. Why have I been blocked?
This website is using a security service to protect itself from online attacks.
Attention required! Please complete the security check to access this page.
Please verify you are a human. Verify you are human by completing the action below. Confirm you are not a robot.
I'm not a robot. Please tick the box below to confirm that you are not a robot. Complete the CAPTCHA.
Our systems have detected unusual traffic from your computer network. This page checks to see if it's really you sending the requests, and not a robot.
You need to enable JavaScript to run this app.
JavaScript is disabled in your browser. Please enable JavaScript to use this site. Please turn on JavaScript and reload the page.
This page requires JavaScript. This site requires JavaScript and cookies to be enabled. Scripts are required.
If you are not redirected automatically, allow scripts for this site.
Your browser is not supported. Your browser is out of date. Please update your browser to view this website.
We use cookies to improve your experience. This website uses cookies to ensure you get the best experience.
Accept all cookies. Reject all. Cookie settings. Manage preferences. Cookies are required to use this site.
Home | About | Contact | Help | Login
Interner Serverfehler. Die angeforderte Seite wurde nicht gefunden. Seite nicht gefunden. Die Seite existiert nicht oder wurde verschoben.
Zugriff verweigert. Sie haben keine Berechtigung für diese Seite. Bitte melden Sie sich an.
Der Dienst ist zurzeit nicht verfügbar. Wegen Wartungsarbeiten nicht verfügbar. Bitte versuchen Sie es später erneut.
Bitte überprüfen Sie die Adresse und versuchen Sie es erneut. Die Verbindung wurde zurückgesetzt.
Bitte aktivieren Sie JavaScript in Ihrem Browser. Diese Seite benötigt JavaScript. Diese Website verwendet Cookies. Cookies müssen aktiviert sein.
Ich bin kein Roboter. Bitte bestätigen Sie, dass Sie ein Mensch sind.
Error interno del servidor. La página solicitada no se ha encontrado. Página no encontrada. La página no existe o se ha movido.
Acceso denegado. No tiene permiso para acceder a esta página. Inicie sesión para continuar.
El servicio no está disponible en este momento. En mantenimiento. Por favor, inténtelo de nuevo más tarde.
Por favor, active JavaScript en su navegador. Esta página requiere JavaScript. Este sitio web utiliza cookies. Debe habilitar las cookies.
No soy un robot. Marque la casilla para demostrar que es una persona. Compruebe la dirección e inténtelo de nuevo.
Erreur interne du serveur. La page demandée est introuvable. Page introuvable. Cette page n'existe pas ou a été déplacée.
Accès refusé. Vous n'avez pas l'autorisation d'accéder à cette page. Veuillez vous connecter.
Le service est momentanément indisponible. Site en maintenance. Veuillez réessayer plus tard.
Veuillez activer JavaScript dans votre navigateur. Cette page nécessite JavaScript. Ce site utilise des cookies. Les cookies doivent être activés.
Je ne suis pas un robot. Cochez la case pour prouver que vous êtes humain. Vérifiez l'adresse et réessayez.
服务器内部错误。您请求的页面不存在。找不到页面。该页面已被移动或删除。
访问被拒绝。您没有权限访问此页面。请先登录。请登录后查看。
服务暂时不可用。系统维护中。请稍后再试。
请在浏览器中启用JavaScript。本页面需要JavaScript。本网站使用Cookie。请启用Cookie后继续。
请完成安全验证。请证明您不是机器人。请检查网址是否正确。"""


KINDS = ("placeholder", "filler", "notice")


def seeds() -> dict[str, list[str]]:
    """Training texts of the residue models; placeholders come from every field in every form, filler also from repeated words, keys and letters."""
    marked = []
    for k, field in enumerate(FIELDS):
        for form in FORMS:
            marked.append(form.format(field))
        for j, label in enumerate(("Title:", "Abstract:", "Authors:", "Keywords:", "Journal:", "Published:", "Published in", "By")):
            marked.append(f"{label} {FORMS[(k + 3 * j) % len(FORMS)].format(field)}")
    typed = [" ".join([x] * TIMES) for x in (*REPEATED, *KEYS)] + [" ".join(KEYS)]
    letters = [chr(c) * 4 for c in range(ord("a"), ord("z") + 1)]
    sentences = lambda x: [p for line in x.split("\n") for p in segments(line)]
    return {"placeholder": marked, "filler": [*sentences(FILLER), *typed, " ".join(letters)], "notice": sentences(NOTICES)}


_NUMBER = re.compile(r"[0-9][0-9a-f]*(?:[.,][0-9][0-9a-f]*)*")
_BLANKS = re.compile(r" {2,}|[^\S\n ]+")
_SEGMENT = re.compile(r"[^\n.!?。！？…]*(?:[.!?…]+(?![\s\n])[^\n.!?。！？…]*)*(?:[.!?…]+(?=\s)|[。！？]|\n|$)")


def simplify(text: str) -> str:
    """Lower case, every number or id of digits and letters a to f as ``0``, blanks collapsed, line ends kept."""
    return _BLANKS.sub(" ", _NUMBER.sub("0", text.lower()))


def slots(text: str) -> np.ndarray:
    """Counter slot of every character n-gram of the text, padded by a line end on both sides."""
    cp = np.frombuffer(f"\n{text}\n".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(cp) < N:
        cp = np.concatenate([cp, np.full(N - len(cp), 10, dtype=np.uint64)])
    h = np.zeros(len(cp) - N + 1, dtype=np.uint64)
    for j in range(N):
        h *= np.uint64(0x100000001B3)
        h += cp[j : len(cp) - N + 1 + j]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h >>= np.uint64(44)
    return h.astype(np.int64) & (WIDTH - 1)


def _same(text: Column) -> Column:
    """``simplify`` as an expression, blanks and line ends as one: texts that differ in numbers only are copies."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), _NUMBER.pattern, "0"), r"(?U)\s+", " "))


#: Characters that are scored in one go.
BLOCK = 300_000


def _blocks(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows ``(text, ...)`` in runs of about ``BLOCK`` characters, with simplified texts."""
    held, size = [], 0
    for text, *more in rows:
        held.append((simplify(text), *more))
        size += len(text)
        if size > BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def fit_prose(df: DataFrame, text_col: str) -> list[np.ndarray]:
    """n-gram counts of the distinct texts (copies, numbers aside, have one vote) and of all rows."""

    def feed(tables: list[np.ndarray], rows: Iterable[tuple]) -> None:
        for held in _blocks(rows):
            for n in {n for _, n in held}:
                got = np.bincount(slots("\n".join(t for t, m in held if m == n)), minlength=WIDTH).astype(np.uint64)
                tables[0] += got
                tables[1] += got * np.uint64(n)

    return corpus_counts(distinct_texts(df, text_col, _same), ["text", "n"], [WIDTH, WIDTH], feed)


#: Share of a text's characters in residue from which the rest of it is learned as residue too, the weight of what is learned, and the share of an n-gram's occurrences that such texts must hold.
MOSTLY, LEARNED, PURE = 0.5, 0.5, 0.05
#: Rounds of learning.
ROUNDS = 2


def fit_residue(df: DataFrame, text_col: str, table: np.ndarray) -> list[np.ndarray]:
    """n-gram counts, per kind, of the distinct texts that ``table`` finds to be mostly residue: what stands beside known residue teaches the wording of the corpus."""

    shared = df.sparkSession.sparkContext.broadcast(table)

    def feed(tables: list[np.ndarray], rows: Iterable[tuple]) -> None:
        peak = shared.value.max(axis=0)
        for held in _blocks(rows):
            texts = [t for t, _ in held]
            for i, (_, _, chars, marks, whole) in judge(texts, shared.value, peak).items():
                if chars >= MOSTLY * whole:
                    tables[max(range(len(KINDS)), key=marks.__getitem__)] += np.bincount(slots(texts[i]), minlength=WIDTH).astype(np.uint64)

    return corpus_counts(distinct_texts(df, text_col, _same), ["text", "n"], [WIDTH] * len(KINDS), feed)


def ratios(prose: list[np.ndarray], learned: list[np.ndarray] | None = None) -> np.ndarray:
    """Log-likelihood ratio of each kind of residue to prose, per slot; ``(kinds, WIDTH)`` float32.

    Prose is what both many texts and many rows hold: the copies of a page cannot make it prose, nor can
    a page be prose where few texts, copied often, leave it a large share of the texts.
    """
    base = np.log(np.minimum.reduce([c / max(1.0, float(c.sum(dtype=np.float64))) for c in prose]) + EPSILON * np.exp(0.5))
    out = []
    for k, texts in enumerate(seeds().values()):
        c = np.zeros(WIDTH)
        for t in texts:
            u, n = np.unique(slots(simplify(t)), return_counts=True)
            c[u] += n
        p = c / max(1.0, c.sum())
        if learned:
            # an n-gram that mostly stands in other texts is prose that happens to stand beside residue
            own = np.where(sum(x.astype(np.float64) for x in learned) >= PURE * prose[0], learned[k], 0).astype(np.float64)
            if own.any():
                p = (1 - LEARNED) * p + LEARNED * own / own.sum()
        out.append(np.clip(np.log(p + EPSILON) - base, -5, 5).astype(np.float32))
    return np.stack(out)


def segments(text: str) -> list[str]:
    """Lines and sentences; an abbreviation's stop may cut too often, never too seldom."""
    return [s for m in _SEGMENT.finditer(text) if (s := m.group().strip())]


#: A segment of fewer n-grams than a window counts only from this mean ratio.
SHORT_STEEP = 3.0
#: A placeholder inside a longer segment: so many n-grams in a row with so high a mean ratio.
MARK_RUN, MARK_MEAN = 8, 3.2
LEAST_MEAN = {"placeholder": 0.3, "filler": 1.0, "notice": 1.0}


def _starts(values: np.ndarray, w: int, least: float, left: np.ndarray) -> np.ndarray:
    """Where ``w`` values in a row, all of one segment (``left``: values to its end), have a mean of ``least``."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    out = np.zeros(len(values), dtype=bool)
    if len(values) >= w:
        out[: len(values) - w + 1] = (sums[w:] - sums[:-w] >= w * least) & (left[: len(values) - w + 1] >= w)
    return out


def judge(texts: list[str], table: np.ndarray, peak: np.ndarray | None = None) -> dict[int, tuple[int, int, int, list[int], int]]:
    """``position of the text → (segments, residue segments, residue characters, characters by kind, characters)`` of simplified texts with residue.

    All texts are scored together. The largest ratio of any kind (``peak``) screens the segments: one without
    a window steep enough for it has none for a kind.
    """
    parts = [segments(t) for t in texts]
    flat = [p for x in parts for p in x]
    if not flat:
        return {}
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in parts])
    length = np.array([len(p) for p in flat])
    grams = np.maximum(length + 2 - N + 1, 0)
    at = slots("\n".join(flat))  # as if each segment stood alone: its own n-grams, then those into the next
    first = np.concatenate([[0], np.cumsum(length + 1)[:-1]])

    best = table.max(axis=0)[at] if peak is None else peak[at]
    sums = np.concatenate([[0.0], np.cumsum(best, dtype=np.float64)])
    hits = [np.flatnonzero(sums[w:] - sums[:-w] >= w * least) for w, least in ((WINDOW, STEEP), (MARK_RUN, MARK_MEAN)) if len(sums) > w]
    some = []
    for at_, w in zip(hits, (WINDOW, MARK_RUN)):
        seg = np.searchsorted(first, at_, side="right") - 1
        some.append(seg[at_ + w <= first[seg] + grams[seg]])
    short = np.flatnonzero((grams > 0) & (grams < WINDOW))
    some.append(short[sums[first[short] + grams[short]] - sums[first[short]] >= SHORT_STEEP * grams[short]])
    some = np.unique(np.concatenate(some))
    if not len(some):
        return {}
    n = grams[some]
    begin = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    inside = np.arange(int(n.sum())) - np.repeat(begin, n)
    where, left = at[np.repeat(first[some], n) + inside], np.repeat(n, n) - inside
    share, kind = np.zeros(len(some)), np.full(len(some), -1)
    for k, name in enumerate(KINDS):
        values = table[k][where]
        mean = np.add.reduceat(values, begin) / n
        hot = _starts(values, WINDOW, STEEP, left)
        edge = np.zeros(len(values) + WINDOW + 1, dtype=np.int32)
        edge[: len(values)] += hot
        edge[WINDOW : WINDOW + len(values)] -= hot
        covered = np.add.reduceat((np.cumsum(edge)[: len(values)] > 0).astype(np.int64), begin) / n
        covered = np.where(n < WINDOW, mean >= SHORT_STEEP, np.where(mean >= LEAST_MEAN[name], covered, 0.0))
        if k == 0:  # an unfilled field inside a sentence
            covered = np.where(np.logical_or.reduceat(_starts(values, MARK_RUN, MARK_MEAN, left), begin), 1.0, covered)
        kind = np.where(covered > share, k, kind)
        share = np.maximum(share, covered)
    out: dict[int, tuple[int, int, int, list[int], int]] = {}
    for i in np.flatnonzero(share >= COVER):
        d = int(owner[some[i]])
        total, bad, chars, marks, whole = out.get(d) or (len(parts[d]), 0, 0, [0] * len(KINDS), sum(map(len, parts[d])))
        size = int(length[some[i]])
        marks[kind[i]] += size
        out[d] = total, bad + 1, chars + size, marks, whole
    return out


def find_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 4) -> DataFrame:
    """``doc_id, n_segments, n_residue, residue_chars, kinds`` of every row that holds residue.

    A row is reported when residue segments (whole lines or sentences that likelihood-ratio windows cover
    by ``COVER``) have at least ``min_chars`` characters; each row of repeated texts is reported. Null and
    empty texts are not. Texts are read whole, whatever their length. The corpus model is counted over
    the distinct texts and over all rows in tables of fixed size and broadcast (12 MB); the smaller share
    counts, so a page stored many times is not prose. The residue models begin with general wordings
    (``seeds``) and learn those of the corpus from the texts that are mostly residue. Scoring is a narrow
    map over all rows.
    """
    prose = fit_prose(df, text_col)
    table = ratios(prose)
    for _ in range(ROUNDS):
        table = ratios(prose, fit_residue(df, text_col, table))
    table = df.sparkSession.sparkContext.broadcast(table)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        peak = table.value.max(axis=0)
        for held in _blocks((t, i) for b in batches for i, t in zip(b["doc_id"], b["text"])):
            out = [
                (held[k][1], n, bad, chars, ",".join(sorted(x for x, m in zip(KINDS, marks) if m)))
                for k, (n, bad, chars, marks, _) in sorted(judge([t for t, _ in held], table.value, peak).items()) if chars >= min_chars
            ]
            yield pd.DataFrame(out, columns=["doc_id", "n_segments", "n_residue", "residue_chars", "kinds"])

    return rows.mapInPandas(run, f"doc_id {kind}, n_segments int, n_residue int, residue_chars int, kinds string")
