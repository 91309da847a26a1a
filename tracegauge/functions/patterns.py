"""Fixed values of detectors: patterns, keyword windows, check weights, number ranges. Plain data, in natural order."""

from __future__ import annotations

PII_TYPES = ("cpf", "cnpj", "credit_card", "phone", "email", "pix_key")
#: Patterns of the types of personal data; (?a) where classes are ASCII alone.
PII = {
    "cpf": r"(?=\d)(?<!\d)(?:\d{3}\.\d{3}\.\d{3}-\d{2}|\d{11})(?!\d)",
    "cnpj": r"(?a)(?=[0-9A-Z])(?<![0-9A-Za-z])(?:[0-9A-Z]{2}\.[0-9A-Z]{3}\.[0-9A-Z]{3}/[0-9A-Z]{4}-[0-9]{2}|[0-9A-Z]{12}[0-9]{2})(?![0-9A-Za-z])",
    "credit_card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?!\d)",
    "phone": r"(?=[\d(+])(?<![\w+.-])(?<!\d[ -])(?:\+?55[ -]?)?(?:\(\d{2}\)|\d{2})[ -]?(?:9\d{4}|[2-5]\d{3})[ -]?\d{4}(?!\d|[ -]\d)",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "pix_key": r"(?<![\w-])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}(?![\w-])",
}
#: The words that must stand near a bare number, and how many characters before it are read.
NEAR = {"cpf": ("cpf", 30), "cnpj": ("cnpj", 30), "phone": (r"(?<!\w)(?:tel|telefone|celular|whatsapp|fone)s?(?!\w)", 30), "pix_key": ("pix", 40)}
#: Weights of the digits before each check digit.
WEIGHTS = {
    "cpf": ((10, 9, 8, 7, 6, 5, 4, 3, 2), (11, 10, 9, 8, 7, 6, 5, 4, 3, 2)),
    "cnpj": ((5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)),
}
#: Area codes in use.
DDDS = [*range(11, 20), 21, 22, 24, 27, 28, *range(31, 36), 37, 38, *range(41, 50), 51, 53, 54, 55, *range(61, 70), 71, 73, 74, 75, 77, 79, *range(81, 90), *range(91, 100)]
#: Card brands by priority: lengths, and ranges of the first digits.
BRANDS = {
    "elo": ((16,), [
        (401178, 401179), (431274, 431274), (438935, 438935), (451416, 451416), (457393, 457393), (457631, 457632), (504175, 504175), (506699, 506778),
        (509000, 509999), (627780, 627780), (636297, 636297), (636368, 636368), (650031, 650033), (650035, 650051), (650405, 650439), (650485, 650538),
        (650541, 650598), (650700, 650718), (650720, 650727), (650901, 650978), (651652, 651679), (655000, 655019), (655021, 655058),
    ]),
    "hipercard": ((16, 19), [(606282, 606282), (3841, 3841)]),
    "amex": ((15,), [(34, 34), (37, 37)]),
    "mastercard": ((16,), [(51, 55), (2221, 2720)]),
    "visa": ((13, 16, 19), [(4, 4)]),
}
#: Credentials with known prefixes, by priority: patterns, and what a text with one has in it.
KNOWN = {
    "aws_access_key": ([r"(?<![A-Za-z0-9_])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9_])"], ("AKIA", "ASIA")),
    "github_token": ([r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}(?![A-Za-z0-9_])", r"(?<![A-Za-z0-9_])github_pat_[A-Za-z0-9_]{22,}"], ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")),
    "llm_api_key": ([r"(?<![A-Za-z0-9_])sk-[A-Za-z0-9_-]{20,}"], ("sk-",)),
    "jwt": ([r"(?<![A-Za-z0-9_])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"], ("eyJ",)),
    "private_key": ([r"-----BEGIN [A-Z ]*PRIVATE KEY-----"], ("-----BEGIN",)),
    "connection_string": ([r"(?<![a-z0-9+.-])[a-z0-9+.-]*+://[^:/\s]+:[^@/\s]+@"], ("://",)),
}
#: A password in a connection string that stands for one.
PLACEHOLDER = r"(?:\*+|<[^>]*>|\$\{[^}]*\})"
KEYWORDS = ("key", "token", "secret", "password", "senha")
