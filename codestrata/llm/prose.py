"""Problem 5: natural language inside code, its language, and its share of each file.

Comments and string literals are cut out by the lexical rules of the language the content is written in.
A passage is prose if it has enough words and the context tree of some human language predicts it better
than the tree of code does; if even the best tree needs too many bits a character it is undetermined.
The trees are trained here: languages on ``documents`` rows with a label, code on file contents, from bounded
samples (``DOCS_PER_LANGUAGE``, ``CODE_FILES``, and of their whole texts ``PARTS_PER_CLASS`` sentences or lines and
``CHARS_PER_CLASS`` characters, all chosen by hash); all files are then scored. A few languages that are
never an answer have trees too (``RIVALS``), so that a script alone does not decide.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codestrata.llm.lexers import Lines, content_language, literals
from codestrata.llm.ppm import Scorer, normalised, train
from codestrata.llm.shared import Model

LANGUAGES = ("en", "zh", "ja", "ko", "de", "fr", "es", "pt", "ru", "pl")
#: Bounds of the training sample: documents a language, files for the code tree, parts and characters a class.
DOCS_PER_LANGUAGE, CODE_FILES, PARTS_PER_CLASS, CHARS_PER_CLASS = 400, 200, 2_500, 120_000
MIN_WORDS, MIN_CJK = 5, 8
#: How much worse than the best seed tree the labelled one may be before a label is taken for wrong.
SEED_MARGIN = 1.02
#: Bits a character beyond which the best language is not believed; more for scripts of many characters.
MOST_BITS, MOST_BITS_CJK = 6.2, 16.0

# Everyday sentences, so that every tree knows its language however few labelled rows there are.
SEEDS = {
    "en": [
        "the and of to in is that it for this with be are not which from must before after when if then only because other there has have been will should could would please check all any its we you they do does",
        "This file was created by a tool and will be overwritten, please do not change it by hand.",
        "Make sure the user has entered a valid number before the record is saved.",
        "Returns true if there are more rows to read, otherwise the list is closed and nothing happens.",
        "We need this workaround because the server sometimes sends an empty answer.",
        "Could not open the file, please try again later or ask your administrator.",
        "The old version did not support this option, so the value is ignored here.",
        "Permission is granted to use, copy and change the software as long as this notice is kept.",
    ],
    "de": [
        "der die das und ist nicht wird werden muss mit für auf von dem den ein eine einer wenn weil noch nach vor über durch bitte nur oder auch sind kann alle keine bei zum zur im aus dass diese dieser",
        "Diese Datei wurde von einem Programm erstellt und wird überschrieben, bitte nicht von Hand ändern.",
        "Vorsicht, hier darf kein leerer Wert übergeben werden, sonst stürzt die Anwendung ab.",
        "Der Benutzer hat keine Berechtigung, diesen Datensatz zu löschen oder zu bearbeiten.",
        "Gibt wahr zurück, wenn noch weitere Zeilen gelesen werden können.",
        "Das Ergebnis wird zwischengespeichert, damit die Abfrage nicht jedes Mal neu ausgeführt werden muss.",
        "Die Schnittstelle zur alten Software wird später entfernt, sobald alle Kunden umgestellt sind.",
    ],
    "fr": [
        "le la les un une des de du et est ne pas que qui pour dans avec sur sont par ce cette il elle doit être si lorsque avant après on vérifie car plus tous aucun cette ligne sera",
        "Ce fichier a été créé par un outil et sera écrasé, merci de ne pas le modifier à la main.",
        "Attention, la valeur ne doit pas être vide, sinon le programme s'arrête avec une erreur.",
        "L'utilisateur n'a pas le droit de supprimer cet enregistrement.",
        "Renvoie vrai s'il reste des lignes à lire, sinon la liste est fermée.",
        "Impossible d'ouvrir le fichier, veuillez réessayer plus tard ou contacter votre administrateur.",
        "Cette fonction calcule le total pour chaque client et garde le résultat en mémoire.",
    ],
    "es": [
        "el la los las un una de del y es no que por para con se en su si cuando antes después más está todavía debe esta este sólo solo sin sobre todos ninguna línea datos",
        "Este archivo fue creado por una herramienta y se sobrescribe, por favor no lo modifique a mano.",
        "Cuidado, el valor no puede estar vacío porque entonces el programa termina con un error.",
        "El usuario no tiene permiso para borrar este registro.",
        "Devuelve verdadero si quedan más filas por leer, de lo contrario cierra la lista.",
        "No se pudo abrir el fichero, inténtelo de nuevo más tarde o consulte con su administrador.",
        "Esta función calcula el total de cada cliente y guarda el resultado en la memoria.",
    ],
    "pt": [
        "o a os as um uma de do da e é não que por para com se em no na quando antes depois mais está ainda deve esta este só sem sobre todos nenhuma linha dados são ser pois após",
        "Este arquivo foi criado por uma ferramenta e será sobrescrito, por favor não o altere manualmente.",
        "Cuidado, o valor não pode estar vazio, senão o programa termina com um erro.",
        "O usuário não tem permissão para apagar este registro.",
        "Retorna verdadeiro se houver mais linhas para ler, caso contrário fecha a lista.",
        "Não foi possível abrir o ficheiro, tente novamente mais tarde ou fale com o administrador.",
        "Esta função calcula o total de cada cliente e guarda o resultado na memória.",
    ],
    "pl": [
        "i w na z do nie jest się że to po od za przed dla oraz jeśli gdy ponieważ ten ta te tej być musi może tylko już przez pod nad dane proszę należy wartość wiersz",
        "Ten plik został utworzony przez narzędzie i zostanie nadpisany, proszę go nie zmieniać ręcznie.",
        "Uwaga, wartość nie może być pusta, bo inaczej program zakończy się błędem.",
        "Użytkownik nie ma uprawnień, aby usunąć ten rekord.",
        "Zwraca prawdę, jeżeli są jeszcze wiersze do odczytania, w przeciwnym razie zamyka listę.",
        "Nie można otworzyć pliku, spróbuj ponownie później lub skontaktuj się z administratorem.",
        "Ta funkcja liczy sumę dla każdego klienta i zapamiętuje wynik.",
    ],
    "ru": [
        "и в не на что с по для это если когда после перед только нужно должен все или так как из при до без этот эта эту он она они будет быть можно потому строка данные значение",
        "Этот файл создан программой автоматически и будет перезаписан, не изменяйте его вручную.",
        "Внимание, значение не может быть пустым, иначе программа завершится с ошибкой.",
        "У пользователя нет прав на удаление этой записи.",
        "Возвращает истину, если ещё есть строки для чтения, иначе список закрывается.",
        "Не удалось открыть файл, попробуйте позже или обратитесь к администратору.",
    ],
    "ko": [
        "이 그 및 를 을 은 는 에서 으로 하지 않습니다 합니다 때 경우 값을 확인 해야 주십시오 있습니다 없으면 대신 사용 모든 전에 후에 데이터",
        "이 파일은 도구로 자동 생성되었으므로 직접 수정하지 마십시오.",
        "파일을 열 수 없습니다. 나중에 다시 시도하거나 관리자에게 문의하십시오.",
        "더 읽을 행이 있으면 참을 반환하고 그렇지 않으면 목록을 닫습니다.",
    ],
    "ja": [
        "この は が を に で と の から まで です ます ください ません する して いる ある ない 場合 必ず 確認 処理 使用 データ とき ため こと もの",
        "このファイルはツールで自動生成されたため、手で変更しないでください。",
        "ファイルを開けませんでした。後でもう一度試すか、管理者に連絡してください。",
        "まだ読む行があれば真を返し、なければ一覧を閉じます。",
    ],
    "zh": [
        "的 是 不 在 有 这 个 這個 和 了 要 請 如果 就 时候 時候 必須 必须 否則 否则 不要 使用 处理 處理 数据 資料 可以 需要 之後 之后 所以 因為 因为",
        "此檔案由工具自動產生，請勿手動修改，否則內容會被覆蓋。",
        "此文件由工具自动生成，请不要手动修改，否则内容会被覆盖。",
        "無法開啟檔案，請稍後再試或聯絡系統管理員。",
        "如果还有数据可以读取就返回真，否则关闭列表。",
    ],
}
# Everyday sentences of languages that share a script with one of the ten.
RIVALS = {
    "uk": [
        "і в не на що з до для це якщо коли після перед тільки потрібно повинен всі або як від при без цей ця він вона вони буде бути можна тому рядок дані значення",
        "Цей файл створено програмою автоматично, його буде перезаписано, не змінюйте його вручну.",
        "Увага, значення не може бути порожнім, інакше програма завершиться з помилкою.",
        "Користувач не має прав на видалення цього запису.",
        "Не вдалося відкрити файл, спробуйте пізніше або зверніться до адміністратора.",
    ],
    "bg": [
        "и в не на че с за по това ако когато след преди само трябва всички или като от при без този тази той тя те ще бъде може защото ред данни стойност",
        "Този файл е създаден автоматично от програма и ще бъде презаписан, не го променяйте ръчно.",
        "Внимание, стойността не може да бъде празна, иначе програмата ще завърши с грешка.",
        "Потребителят няма права да изтрие този запис.",
        "Файлът не може да се отвори, опитайте по-късно или се обърнете към администратора.",
    ],
}
SQL_SEED = "select from where and or insert into values update set delete group by order by having left join inner join on as is null not null create table drop table if exists primary key default begin end"

_WORD = re.compile(r"(?<![\w$@%&.\\/:-])[^\W\d_]+(?:['’-][^\W\d_]+)*(?![\w\\/@:(]|\.\w|-\d)|(?<=[(\"«„“'¿¡])[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]")
_KANA, _HANGUL, _CYRILLIC = re.compile(r"[぀-ヿ]"), re.compile(r"[가-힯]"), re.compile(r"[Ѐ-ӿ]")
_CAMEL = re.compile(r"[a-z][A-Z]")
_EDGE = re.compile(r"^(?://+|--+|/\*+|\*+/?|\(\*+|\{+|;+|#+|<!--|!|REM\b)[ \t]*|[ \t]*(?:\*+/|\*+\)|\}|-->)[ \t\r]*$")
_STATEMENT = re.compile(r"^(?:select|insert|update|delete|create|drop|alter|with|exec|merge|grant)\s.*\b(?:from|into|set|table|where|values|view|join)\b|:=|[;{}]\s*$|^\w+(?:\.\w+)*\(.*\);?$", re.I | re.S)
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)


def cleaned(line: str) -> str:
    s = line.strip()
    for _ in range(3):
        t = _EDGE.sub("", s).strip()
        if t == s:
            break
        s = t
    return s


def enough(text: str) -> bool:
    """At least five words, or eight characters of Chinese, Japanese or Korean."""
    if text.count(" ") < MIN_WORDS - 1 and (len(text) < MIN_CJK or text.isascii()):
        return False
    if len(_CJK.findall(text)) >= MIN_CJK:
        return True
    return len(text) >= 2 * MIN_WORDS and sum(1 for w in _WORD.findall(text) if not _CAMEL.search(w)) >= MIN_WORDS


def passages(path: str | None, text: str) -> Iterator[tuple[int, str, str]]:
    """Candidate passages as ``(offset, what is judged, whole passage)``.

    Lines of comments, comments as a whole if their lines are short, joined literals. Short lines behind a
    judged one of the same comment belong to it.
    """
    language = content_language(path, text)
    block: list[tuple[int, str]] = []
    block_end = -1
    chain, chain_at, chain_end = "", 0, -1

    def flush() -> Iterator[tuple[int, str, str]]:
        lines = [x for x in block if x[1]]
        block.clear()
        if not any(enough(x) for _, x in lines):
            if len(lines) > 1 and enough(joined := " ".join(x for _, x in lines)):
                yield lines[0][0], joined, joined
            return
        at, judged, whole = 0, "", ""
        for a, x in lines:
            if enough(x):
                if judged:
                    yield at, judged, whole
                at, judged, whole = a, x, x
            elif judged:
                whole += f" {x}"
        yield at, judged, whole

    def literal() -> Iterator[tuple[int, str, str]]:
        if chain and enough(chain):
            one = " ".join(chain.split())
            yield chain_at, one, one

    for kind, a, b in literals(language, text):
        if kind == "c":
            if block and text[block_end:a].strip():
                yield from flush()
            at = a
            for x in text[a:b].split("\n"):
                block.append((at, cleaned(x)))
                at += len(x) + 1
            block_end = b
        elif kind in "sr":
            body = text[a + 1 : b - 1] if b - a > 1 and text[b - 1] == text[a] else text[a + 1 : b]
            if kind == "s" and language in ("pascal", "sql", "form"):
                body = body.replace("''", "'")
            elif kind == "s" and "\\" in body:
                body = re.sub(r"\\[nrt]", " ", body).replace("\\", "")
            if chain_end >= 0 and a - chain_end < 200 and _JOINT.match(text[chain_end:a]):
                chain += body
            else:
                yield from literal()
                chain, chain_at = body, a
            chain_end = b
    yield from flush()
    yield from literal()


_JOINT = re.compile(r"[ \t\r\n]*(?:\+|\|\|)[ \t\r\n]*(?:(?:sLineBreak|#\d+)[ \t\r\n]*(?:\+[ \t\r\n]*)?)*$", re.I)


def candidates(text: str) -> tuple[str, ...]:
    """Languages of the text's script."""
    cjk = len(_CJK.findall(text))
    if cjk >= MIN_CJK or cjk > len(text) // 4:
        if len(_HANGUL.findall(text)) * 2 >= cjk:
            return ("ko", "ja", "zh") if _KANA.search(text) else ("ko",)
        return ("ja", "zh") if not _KANA.search(text) else ("ja",) if len(_KANA.findall(text)) * 8 >= cjk else ("ja", "zh")
    if len(_CYRILLIC.findall(text)) * 3 > len(text):
        return ("ru", *RIVALS)
    return ("de", "en", "es", "fr", "pl", "pt")


_CODED = re.compile(r"(?<!\S)\S*[\w][_@\\/=]\S*|(?<!\S)/(?!\S)")


class Judge:
    """Decides the language of passages; equal passages (digits aside) are judged once."""

    def __init__(self, scorer: Scorer):
        self.scorer = scorer
        self.at = {n: i for i, n in enumerate(scorer.names)}
        self.language = lru_cache(maxsize=200_000)(self._language)

    def _language(self, text: str) -> str | None:
        e = self.scorer.entropies(_CODED.sub(" ", text))
        names = [c for c in candidates(text) if c in self.at]
        if not names:
            return None
        best = min(names, key=lambda c: (float(e[self.at[c]]), c))
        bits = float(e[self.at[best]])
        cjk = best in ("zh", "ja", "ko")
        if best in RIVALS or bits > (MOST_BITS_CJK if cjk else MOST_BITS):
            return None
        if not cjk and "code" in self.at and (float(e[self.at["code"]]) < bits or _STATEMENT.search(text)):
            return None
        return best

    def of(self, text: str) -> str | None:
        return self.language(re.sub(r"\d+", "0", text))


def _sentences(text: str) -> Iterator[str]:
    for part in re.split(r"\n+|(?<=[.!?])\s+(?=[^\W\d_a-z])|(?<=[。！？])", _FENCE.sub("\n", text)):
        if part := part.strip():
            yield part


def _code_lines(path: str | None, text: str) -> Iterator[str]:
    """Lines of a file without its comments and its prose literals."""
    kept, end = [], 0
    for k, a, b in literals(content_language(path, text), text):
        body = text[a + 1 : b - 1]
        kept.append(text[end:a])
        if k in "sr" and (_STATEMENT.search(body) or not enough(body)):
            kept.append(body)
        end = b
    for line in "".join([*kept, text[end:]]).split("\n"):
        if len(line := line.strip()) > 8:
            yield line


def _foremost(parts: DataFrame) -> DataFrame:
    """Of every class the ``PARTS_PER_CLASS`` distinct parts with the smallest hashes."""
    order = W.partitionBy("class").orderBy(F.xxhash64("part"), "part")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PARTS_PER_CLASS)


def labelled_parts(documents: DataFrame) -> DataFrame:
    """``(class, part, votes, rank)``: sentences of sampled documents, whole texts, and whether most rows name this language.

    The documents are chosen on ids alone, by hash; only their texts are then read. Labels may be wrong: a
    sentence stays with the language that most rows with it name.
    """
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = documents.select("doc_id", "lang").where(F.col("lang").isin(*LANGUAGES) & F.col("doc_id").isNotNull())
    chosen = ids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= DOCS_PER_LANGUAGE).select("doc_id").distinct()
    wanted = [r["doc_id"] for r in chosen.collect()]
    texts = documents.where(F.col("doc_id").isin(*wanted) & F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull()).select("lang", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for lang, text in zip(b["lang"], b["text"]):
                for part in _sentences(text):
                    fits = enough(part) and not re.search(r"[{};=]|\w_\w", part) and lang in candidates(part)
                    rows.append((normalised(part), lang, part if fits else None))
            yield pd.DataFrame(rows, columns=["known", "class", "part"], dtype=object)

    named = texts.mapInPandas(run, "known string, class string, part string").groupBy("known", "class").agg(F.count("*").alias("n"), F.min("part").alias("part"))
    most = named.groupBy("known").agg(F.max("n").alias("most"))
    return _foremost(named.join(most, "known").where((F.col("n") == F.col("most")) & F.col("part").isNotNull()).select("class", "part"))


def code_parts(files: DataFrame) -> DataFrame:
    """``(class, part, rank)``: distinct lines of code of sampled files, whole texts."""
    ids = [r["id"] for r in files.select("id").where(F.col("id").isNotNull()).distinct().orderBy(F.xxhash64("id"), "id").limit(CODE_FILES).collect()]
    texts = files.where(F.col("id").isin(*ids) & F.col("content").isNotNull()).select("filePath", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lines = {x for path, text in zip(b["filePath"], b["content"]) for x in _code_lines(path, text)}
            yield pd.DataFrame({"class": "code", "part": list(lines)}, dtype=object)

    return _foremost(texts.mapInPandas(run, "class string, part string").distinct())


def training_samples(documents: DataFrame, files: DataFrame) -> dict[str, list[str]]:
    """The bounded sample a class; wrongly labelled sentences that the seeds speak against are left out."""
    samples: dict[str, list[str]] = {c: list(SEEDS[c]) for c in LANGUAGES}
    samples["code"] = [SQL_SEED, *_identifiers()]
    sizes = dict.fromkeys(samples, 0)
    seeds = Scorer(train({c: SEEDS[c] for c in LANGUAGES}))
    at = {n: i for i, n in enumerate(seeds.names)}
    got = labelled_parts(documents).unionByName(code_parts(files)).collect()
    for r in sorted(got, key=lambda r: (r["class"], r["rank"])):
        c, part = r["class"], r["part"]
        if sizes[c] >= CHARS_PER_CLASS:
            continue
        if c != "code":
            e = seeds.entropies(part)
            if e[at[c]] > SEED_MARGIN * min(e[at[x]] for x in candidates(part) if x in at):
                continue
        samples[c].append(part)
        sizes[c] += len(part)
    return samples


def _identifiers() -> list[str]:
    return ["if (x == null) { return 0; }", "for i := 0 to count - 1 do", "result := value;", "func (s *service) name(id int64) error {", "%s: %w", "procedure tform.click(sender: tobject);"]


def relabelled(samples: dict[str, list[str]]) -> dict[str, list[str]]:
    """One round of cleaning: parts that another language's tree predicts clearly better are left out (wrong labels)."""
    judge = Scorer(train(samples, 3))
    at = {n: i for i, n in enumerate(judge.names)}
    out = {}
    for name, parts in samples.items():
        kept = []
        for k, p in enumerate(parts):
            if name in SEEDS and k >= len(SEEDS[name]):
                e = judge.entropies(p)
                rivals = [e[at[c]] for c in candidates(p) if c != name and c in at]
                if rivals and min(rivals) < e[at[name]] * 0.95:
                    continue
            kept.append(p)
        out[name] = kept
    return out


def trained_model(documents: DataFrame, files: DataFrame) -> bytes:
    """The pickled trees; their size is bounded by the sample's bounds, so they may be broadcast."""
    return pickle.dumps(train(relabelled(training_samples(documents, files)) | RIVALS), protocol=5)


def _judged(files: DataFrame, documents: DataFrame, rows_of: Callable[[int, str, list[tuple[int, str, str]]], list[tuple]], schema: str) -> DataFrame:
    """One pass over the files; ``rows_of(id, text, [(offset, language, passage)])`` gives a file's rows.

    Null and empty contents give no rows; undetermined passages have no language and are left out; repeated
    rows repeat their results. No shuffle; the trees are broadcast (bounded, see above).
    """
    model = Model(files.sparkSession, trained_model(documents, files))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = model.load(lambda trees: Judge(Scorer(trees)))
        for b in batches:
            rows = []
            for i, path, text in zip(b["id"], b["filePath"], b["content"]):
                rows += rows_of(i, text, [(at, lang, whole) for at, judged, whole in passages(path, text) if (lang := judge.of(judged))])
            yield pd.DataFrame(rows, columns=names, dtype=object)

    kept = files.select("id", "filePath", "content").where((F.length("content") > 0) & F.col("id").isNotNull())
    return kept.mapInPandas(run, schema)


def prose_passages(files: DataFrame, documents: DataFrame) -> DataFrame:
    """``(fileId, lineNumber, lang, passage)``: every passage with its language and the line where it begins."""

    def rows(i: int, text: str, found: list[tuple[int, str, str]]) -> list[tuple]:
        lines = Lines(text)
        return [(i, lines.of(at), lang, whole) for at, lang, whole in found]

    return _judged(files, documents, rows, "fileId long, lineNumber int, lang string, passage string")


def prose_spans(files: DataFrame, documents: DataFrame) -> DataFrame:
    """``(fileId, lang, passages, chars, share)`` per file and language found in it.

    ``share`` is the part of the file's characters that stands in passages of that language.
    """

    def rows(i: int, text: str, found: list[tuple[int, str, str]]) -> list[tuple]:
        sizes: dict[str, list[int]] = {}
        for _, lang, whole in found:
            sizes.setdefault(lang, []).append(len(whole))
        return [(i, lang, len(n), sum(n), sum(n) / len(text)) for lang, n in sizes.items()]

    return _judged(files, documents, rows, "fileId long, lang string, passages int, chars long, share double")


def prose_languages(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Query ``p5_found``: one row per file and language."""
    return _judged(files, documents, lambda i, text, found: [(i, lang) for lang in dict.fromkeys(x[1] for x in found)], "fileId long, lang string")
