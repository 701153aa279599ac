"""Text, hashing and naming expressions: pure Column builders, all inside code generation."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\n\r\f]"
#: What an upload's name may not hold, and the patterns of dangerous input.
FORBIDDEN_NAME = r"""[<>"'|?*\\]"""
UPLOADS = [".pdf", ".docx", ".doc", ".xlsx", ".xls", ".csv", ".txt", ".md", ".rtf", ".png", ".jpg", ".jpeg", ".tiff"]
UPLOAD_BYTES = 100 * 1024 * 1024
DANGEROUS = [
    r"(?i)<script[^>]*>",
    r"(?i)javascript:",
    r"(?i)on[a-z]+ *=",
    r"(?i)(union +select|drop +table|insert +into|delete +from)",
    r"\.\./",
    r"(?i)%2e",
]
#: The weighted patterns of the rule classifier, by document type; case doesn't count.
RULES = [
    ("invoice", r"(сч[её]т\s*[-—]\s*фактур|invoice|сч[её]т\s*№|сч[её]т\s*на\s*оплат)", 0.9),
    ("invoice", r"(ндс|сумма\s*без\s*ндс|итого\s*к\s*оплат)", 0.7),
    ("invoice", r"(плат[её]ж|квитанц|чек)", 0.5),
    ("contract", r"(договор|контракт|contract|agreement)", 0.9),
    ("contract", r"(стороны|заказчик|исполнитель|подрядчик)", 0.7),
    ("contract", r"(реквизиты\s*сторон|юридический\s*адрес)", 0.6),
    ("report", r"(отч[её]т|report|анализ|статистик)", 0.8),
    ("report", r"(период\s*отч[её]та|показатели|динамика)", 0.6),
    ("letter", r"(уважаем|здравствуй|письмо|обращение|ходатайств)", 0.8),
    ("letter", r"(в\s*ответ\s*на|направля|уведомл|извещ)", 0.6),
    ("form", r"(анкет|заявлени|form|опросный\s*лист)", 0.8),
    ("form", r"(заполните|отметьте|выберите|укажите)", 0.6),
    ("identity", r"(паспорт|passport|свидетел|удостоверен)", 0.9),
    ("identity", r"(серия\s*№|кем\s*выдан|прописк|регистраци)", 0.7),
    ("medical", r"(диагноз|анализ\s*кров|медицинск|больниц|клиник|пациент)", 0.8),
    ("medical", r"(врач|рецепт|лечени|симптом)", 0.6),
    ("legal", r"(иск\s|суд|прокур|адвокат|нотариус)", 0.8),
    ("legal", r"(статья\s*\d|закон|кодекс|постановлен)", 0.6),
]
#: Fixed value: how many characters of a text the rules look at.
RULES_READ = 5000


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def paragraphs(text: Column) -> Column:
    """Stripped, non-empty paragraphs: text parted at blank lines."""
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda x: x != "")


def pair_text(columns: Iterable[str]) -> Column:
    """"name: value" of each column, joined by bars; null values are empty."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^ \t\n\r\f]+"), F.lit(0))


#: Fixed value: what counts as a term of a question.
TERM = r"[A-ZА-ЯЁ]{2,}|[A-Za-z]{3,}|[а-яё]{4,}"


def query_terms(text: Column) -> Column:
    """The terms of a question, in order, repeats too."""
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def dangerous(text: Column) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in DANGEROUS))


def sanitized(text: Column) -> Column:
    return strip(reduce(lambda c, p: F.regexp_replace(c, p, ""), DANGEROUS, text))


def uuid5(name: Column, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """RFC 4122 version 5, by default in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def md5_mod100(text: Column) -> Column:
    """The md5 hash, as a number, modulo 100, in four limbs of 32 bits."""
    h = F.md5(text)
    limb = lambda i: F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long")
    return F.pmod(36 * limb(0) + 16 * limb(1) + 96 * limb(2) + limb(3), F.lit(100))


def news_key(title: Column, date: Column) -> Column:
    return F.concat(F.lower(F.substring(strip(title), 1, 80)), F.lit("|"), F.substring(date, 1, 10))


def page_preview(html: Column, raw: int = 500, shown: int = 300) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.substring(html, 1, raw), "<[^>]*>", " "), f"{BLANK}+", " ")
    return F.substring(strip(plain), 1, shown)


def json_object(text: Column) -> Column:
    """The JSON object in a model's answer: code fences off, from the first brace to the last."""
    bare = F.regexp_replace(text, "```(json)?", "")
    return F.regexp_extract(bare, r"(?s)(\{.*\})", 1)


def upload_verdict(size: Column, name: Column) -> Column:
    """empty, too_large, extension, forbidden_character or ok: the first that holds."""
    known = F.regexp_extract(F.lower(name), "([.][^.]*)$", 1).isin(*UPLOADS)
    return F.when(size == 0, "empty").when(size > UPLOAD_BYTES, "too_large").when(~known, "extension").when(name.rlike(FORBIDDEN_NAME), "forbidden_character").otherwise("ok")


def json_array(text: Column) -> Column:
    """The first JSON array in a model's answer, up to the first bracket that closes; empty if there is none."""
    return F.regexp_extract(text, r"(?s)\[.*?\]", 0)


def base_name(name: Column) -> Column:
    """A file's name without its path, with slashes of either kind, and without NUL; "file" where nothing is left."""
    bare = F.regexp_extract(F.replace(F.replace(name, F.lit("\0"), F.lit("")), F.lit("\\"), F.lit("/")), "([^/]*)$", 1)
    return F.when(bare.isin("", ".", ".."), "file").otherwise(bare)


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^.]([.][^.]*)$", 1))


def histogram_bucket(value: Column, bounds: list[float]) -> Column:
    return reduce(lambda c, b: c.when(value <= b, F.lit(float(b))), bounds[1:], F.when(value <= bounds[0], F.lit(float(bounds[0]))))


#: Elements of a page that hold no main text.
ASIDE = ("script", "style", "noscript", "nav", "header", "footer", "aside", "form")


def main_text(html: Column) -> Column:
    """A page's main text: its article, else its main element, else its body, without what stands aside, tags as spaces."""
    c = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    for tag in ASIDE:
        c = F.regexp_replace(c, f"(?is)<{tag}\\b[^>]*>.*?</{tag}>", " ")
    inner = [F.regexp_extract(c, f"(?is)<{tag}\\b[^>]*>(.*)</{tag}>", 1) for tag in ("article", "main", "body")]
    c = F.coalesce(*[F.when(i != "", i) for i in inner], c)
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), "[ \\t\\r\\n\\f]+", " "))


def regional_hash(c: Column, bits: int = 256) -> Column:
    """The digest that stands in where the regional algorithm isn't installed: SHA-2 of the same length."""
    if bits not in (256, 512):
        raise ValueError("256 or 512 bits")
    return F.sha2(c, bits)


def sealed(text: Column, key: Column) -> Column:
    """Nonce, cipher text and tag of AES-256-GCM in base64; the key has 32 bytes."""
    return F.base64(F.aes_encrypt(text, key, F.lit("GCM")))


def opened(sealed_text: Column, key: Column) -> Column:
    """The text, or null where the key is another one or the text was changed."""
    return F.try_aes_decrypt(F.unbase64(sealed_text), key, F.lit("GCM")).cast("string")
