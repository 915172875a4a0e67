"""Text columns: spending categories, merchant names and token sets, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first category with a needle in the lower-cased payee and description wins.
CATEGORY_RULES = (
    ("Income", ("payroll", "direct deposit", "intellibridge", "town of greenwich", "salary", "pay transfer")),
    ("Transfers", ("online payment", "card payment", "autopay", "thank you", "ach", "zelle", "venmo", "transfer",
                   "payment to", "credit card", "applecard", "gsbank", "check #", "auto finan", "car fin", "loan pmt",
                   "loan disbursement", "disbursement", "loan proceeds")),
    ("Taxes", ("state of ct", "dept of revenue", "department of revenue", "irs", "franchise tax", "tax payment")),
    ("Fees", ("interest charge", "interest:", "interest", "late fee", "annual fee", "membership fee", "renewal membership",
              "cash advance fee", "finance charge", "service fee", "atm fee", "foreign transaction")),
    ("Insurance", ("safeco", "geico", "allstate", "progressive", "state farm", "insurance")),
    ("Utilities", ("eversource", "national grid", "water dept", "electric", "natural gas", "comcast", "xfinity", "verizon", "optimum", "aquarion", "gault energy")),
    ("Software", ("openai", "anthropic", "claude.ai", "google cloud", "cursor", "vercel", "github", "perplexity", "midjourney", "elevenlabs", "notion", "zoho", "superhuman", "paddle", "ynab")),
    ("BNPL", ("affirm", "afterpay", "klarna", "pay in 4", "paypal pay", "sezzle")),
    ("Subscriptions", ("spotify", "netflix", "plex", "new york times", "nyt", "apple.com/bill", "hulu", "disney", "youtube", "icloud", "google one", "kindle", "paramount", "amazon prime", "peloton", "ring services")),
    ("Pets", ("vca", "vetsource", "chewy", "animal hospital", "veterinary")),
    ("Groceries", ("whole foods", "stop & shop", "stop and shop", "trader joe", "costco", "shoprite", "wegmans", "supermarket", "citarella")),
    ("Dining", ("restaurant", "coffee", "starbucks", "dunkin", "pizza", "grill", "cafe", "doordash", "uber eats", "grubhub", "tavern", "wendy", "cava", "7-eleven", "geoff")),
    ("Transport", ("shell", "exxon", "mobil", "gulf", "uber", "lyft", "mta", "metro-north", "parking", "gas station", "sunoco", "citgo", "ford", "audi", "metropolis", "passny")),
    ("Shopping", ("amazon", "target", "walmart", "best buy", "apple store", "home depot", "etsy", "marine layer", "babolat", "alex mill", "mother denim")),
    ("Health", ("pharmacy", "cvs", "walgreens", "anthem", "dental", "medical", "doctor", "psycholog", "psychiatry", "therapy", "mychart", "plushcare", "flyte medical", "morning spa")),
)
#: Words too generic to tell merchants apart.
STOP_TOKENS = ("the", "inc", "llc", "co", "card", "payment", "web", "online", "bill", "autopay", "ppd", "id", "pos", "purchase", "estimate", "estimates")
#: Words that tell nothing when two lists of labels are compared.
LABEL_STOP_TOKENS = (
    "pay", "payment", "the", "for", "and", "via", "from", "into", "due", "est", "estimate", "bill", "charge", "charges", "fee", "fees", "to", "of", "on", "tax", "taxes", "premium", "insurance",
    "subscription", "utility", "utilities", "rent", "mortgage", "loan", "credit", "debit", "service", "interest", "deposit", "statement", "monthly", "annual", "account", "balance", "minimum", "recurring",
)
#: Words of usage-based bills, and marks of money moved between own accounts.
USAGE_KEYWORDS = (
    "energy", "electric", "eversource", "gault", "aquarion", "gas", "water", "heating", "fuel", "oil", "propane", "utility", "kwh", "power", "pseg", "coned", "grid", "hvac",
)
INTERNAL_TOKENS = ("transfer", "autopay")
INTERNAL_SUBSTRINGS = ("credit_card", "card_payment", "online_transfer", "payment_thank")


def category(payee: Column, description: Column) -> Column:
    """The first category of CATEGORY_RULES with a needle in the text, else Other; nulls count as empty."""
    text = F.lower(F.concat_ws(" ", F.coalesce(payee, F.lit("")), F.coalesce(description, F.lit(""))))
    chain = None
    for name, needles in CATEGORY_RULES:
        hit = F.lit(False)
        for needle in needles:
            hit = hit | F.contains(text, F.lit(needle))
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise("Other")


def titled(c: Column) -> Column:
    """Capitals after every character that is not a letter (so after ' and - too), the rest lower case."""
    lower = F.lower(c)
    return F.array_join(F.transform(F.split(lower, r"(?<=\P{L})"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def merchant(payee: Column) -> Column:
    """Payee without store numbers and edge marks, in title case; Unknown where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(payee, F.lit("")), r"#?\d{2,}", ""), r"\s+", " ")
    bare = F.btrim(bare, F.lit(" -*#"))
    return F.when(bare == "", "Unknown").otherwise(titled(bare))


def slug(c: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "_"), F.lit("_"))


def tokens(c: Column, stop: tuple[str, ...] = STOP_TOKENS) -> Column:
    """Distinct words of three characters or more that are neither numbers nor stop words."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*stop) & ~w.rlike("^[0-9]+$")))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token sets; 0 where either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / either)


def is_internal(key: Column) -> Column:
    """Whether a merchant key looks like money moved between own accounts."""
    hit = F.arrays_overlap(F.split(key, "_"), F.array(*[F.lit(t) for t in INTERNAL_TOKENS]))
    for part in INTERNAL_SUBSTRINGS:
        hit = hit | F.contains(key, F.lit(part))
    return hit


def is_usage(key: Column) -> Column:
    return F.arrays_overlap(F.split(key, "_"), F.array(*[F.lit(t) for t in USAGE_KEYWORDS]))
