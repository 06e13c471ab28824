"""Labels from names and texts by ordered patterns: sectors, report sectors by a borrower's vote, manager families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import cleaned_identifier

# Sectors and their patterns over cleaned identifiers, in order; the first that fits wins.
SECTORS = [
    ("Financials & Insurance", r"(collateralized loan obligation|clo subordinated notes|structured finance)"),
    ("Healthcare", r"\b(healthcare|health care|clinic|clinics?|medical|hospital|hospitals|dental|vision|pharma|pharmaceuticals?|biotech|biosciences?|imaging|fertility|rx\b|pharmacy)\b"),
    ("Technology", r"\b(software|saas|technology|technologies|it services?|cyber|cloud|data center|digital)\b"),
    (
        "Financials & Insurance",
        r"\b(bank|banking|financial|finance|funding|fund\b|funds\b|capital partners|capital management|asset management|insurance|brokerage)",
    ),
    ("Transportation", r"\b(airline|airlines|airways|shipping|shipper|marine transport|fleet services|logistics carrier)\b"),
    (
        "Consumer",
        r"\b(food|foods|beverage|beverages|brew|bakery|baking|tobacco|grocery|grocer|supermarket|convenience store"
        r"|restaurant|restaurants|cafe|caf[eé]|hotel|resort|casino|gaming|leisure|fitness|gym|auto dealer|car wash|cinema|theater|theatre|retail|retailer|mall|shopping"
        r"|wholesale|wholesaler|distributor|education|educational|school|university|college|learning|training)\b",
    ),
    ("Industrials", r"\b(industrial|manufactur|factory|plant|engineering|equipment|logistics|distribution|warehouse|trucking|freight|railroad|railway)\b"),
    ("Energy & Utilities", r"\b(energy|power|electricity|solar|wind|renewable|pipeline|oil\b|gas\b|utilities|water utility|electric utility|gas utility)\b"),
    ("Materials", r"\b(materials?|chemicals?|plastics?|rubber|packaging)\b"),
    ("Real Estate", r"\b(real estate|properties|property|reit|apartment|apartments|office park|logistics park|industrial park)\b"),
    (
        "Communication & Media",
        r"\b(telecom|telecommunications?|cable tv|wireless carrier|media|advertising|marketing agency|entertainment|streaming|content studio|film studio|music label)\b",
    ),
]
OTHER_SECTOR = "Other / Unknown"
SOFTWARE, OTHER_TECHNOLOGY, SERVICES, OTHER_INDUSTRIALS = "Software", "Technology (ex-software)", "Business Services", "Industrials (ex-business services)"
PARTS = {"Technology": (SOFTWARE, OTHER_TECHNOLOGY), "Industrials": (SERVICES, OTHER_INDUSTRIALS)}
SOURCE_NOTE = r"(?i)\s*\((?:\d+ of \d+ BDCs|sibling rows|other BDCs?|related entity)\)"
SOFTWARE_TEXT = r"(?i)software|\bsaa?s\b|application|\berp\b|\bcrm\b|cyber"
SERVICES_TEXT = (
    r"(?i)professional|commercial (?:and professional )?services|commercial services|business|consult|support services|staffing|human resource|\bhr\b|outsourc|marketing|advertis"
    r"|research|training|testing|inspection|certification|environmental and facilities|facilit(?:y|ies) services|security services|information services|data and analytics|payroll"
    r"|benefits|document|printing|call center|\bbpo\b|engineering services|legal services|accounting|compliance"
)
NO_SERVICES_TEXT = r"(?i)energy equipment|oilfield|freight|logistics|transport|airline|marine|aerospace|construction and engineering"
# Managers by what a lender's name says, in order; and lenders whose names do not say theirs.
FAMILIES = [
    (r"apollo", "Apollo"), (r"\bares\b", "Ares"), (r"blackstone", "Blackstone"), (r"\bowl\b", "Blue Owl"), (r"goldman|phillip street", "Goldman Sachs"),
    (r"\bkkr\b|^fs investment", "FS KKR"), (r"main street|^hms income", "Main Street"), (r"\bhps\b", "HPS"), (r"carlyle|^tcg bdc", "Carlyle"),
    (r"north haven|^sl investment|morgan stanley|^t series middle market", "Morgan Stanley"), (r"bain capital", "Bain Capital"), (r"blackrock", "BlackRock"),
    (r"antares", "Antares"), (r"barings", "Barings"), (r"lord abbett", "Lord Abbett"), (r"new mountain|^nmf slf", "New Mountain"), (r"monroe capital", "Monroe Capital"),
    (r"golub", "Golub"), (r"^ab private", "AllianceBernstein"), (r"audax", "Audax"), (r"nuveen churchill", "Nuveen Churchill"), (r"oaktree|^fifth street", "Oaktree"),
    (r"twin brook", "TPG Angelo Gordon (Twin Brook)"), (r"sixth street|^tpg specialty lending", "Sixth Street"), (r"\boha\b", "OHA (T. Rowe Price)"), (r"^crescent", "Crescent"),
    (r"^fidelity", "Fidelity"), (r"franklin bsp|^business development corp of america", "Franklin BSP"), (r"^gladstone", "Gladstone"), (r"^kayne", "Kayne Anderson"),
    (r"^muzinich", "Muzinich"), (r"pennantpark", "PennantPark"), (r"^silver point", "Silver Point"), (r"^slr\b|^solar capital|^scp private credit", "SLR"), (r"^stellus", "Stellus"),
    (r"^stone point", "Stone Point"), (r"^tcw\b", "TCW"), (r"^triplepoint", "TriplePoint"), (r"^venture lending & leasing|^wti fund", "Western Technology Investment"),
    (r"^investcorp|^cm finance", "Investcorp"), (r"^bc partners|^kohlberg capital|portman ridge|logan ridge|^capitala", "BC Partners"), (r"^hancock park|^ofs capital", "OFS"),
    (r"^prospect|^triton pacific", "Prospect"), (r"jefferies", "Jefferies"), (r"comvest", "Comvest"),
]
LENDERS = {
    1414932: "Oaktree", 1379785: "Barings", 1370755: "BlackRock", 1959568: "Jefferies", 1983514: "Morgan Stanley", 2020354: "Goldman Sachs",
    2083477: "OHA (T. Rowe Price)", 2017636: "Crescent", 1841514: "Comvest",
}


def _first(cases: list[tuple[Column, str]]) -> Column:
    out = F.when(*cases[0])
    for condition, label in cases[1:]:
        out = out.when(condition, label)
    return out


def sector(identifier: Column) -> Column:
    """The sector that an identifier's words name; Other / Unknown if none."""
    text = F.coalesce(cleaned_identifier(identifier), F.lit(""))
    return _first([(text.rlike(pattern), label) for label, pattern in SECTORS]).otherwise(OTHER_SECTOR)


def report_sector(sector: Column, evidence: Column) -> Column:
    """A sector with software and business services told apart by the reported industry text."""
    text = F.regexp_replace(F.coalesce(evidence, F.lit("")), SOURCE_NOTE, "")
    services = text.rlike(SERVICES_TEXT) & ~text.rlike(NO_SERVICES_TEXT)
    return (
        F.when(sector == "Technology", F.when(text.rlike(SOFTWARE_TEXT), SOFTWARE).otherwise(OTHER_TECHNOLOGY))
        .when(sector == "Industrials", F.when(services, SERVICES).otherwise(OTHER_INDUSTRIALS))
        .otherwise(sector)
    )


def report_sectors(labels: DataFrame) -> DataFrame:
    """``investment_identifier, sector_report`` of labelled identifiers (``borrower, sector, evidence, rows``): in split sectors the label most of a borrower's rows have.

    Votes are weighted by ``rows`` (none or 0: one); equal ones go to the label that comes first.
    """
    own = labels.withColumn("_label", report_sector(F.col("sector"), F.col("evidence")))
    votes = own.where((F.col("borrower") != "") & F.col("sector").isin(*PARTS))
    weight = F.when(F.col("rows") != 0, F.col("rows")).otherwise(1)
    counts = votes.groupBy("borrower", "sector", "_label").agg(F.sum(weight).alias("_votes"))
    winner = counts.groupBy("borrower", "sector").agg(F.min(F.struct((-F.col("_votes")).alias("v"), F.col("_label").alias("label"))).alias("_w"))
    out = own.join(winner, ["borrower", "sector"], "left")
    return out.select("investment_identifier", F.coalesce("_w.label", "_label").alias("sector_report"))


def families(filings: DataFrame) -> DataFrame:
    """``cik, family`` of every lender of a filing index (``cik, company, date``): its manager by any of its names, else its latest name, else its number.

    The first pattern that fits any name wins; names of one lender are compared in one pass.
    """
    name = F.trim("company")
    fits = _first([(F.lower(name).rlike(pattern), F.lit(i)) for i, (pattern, _) in enumerate(FAMILIES)])
    per = filings.select(F.col("cik").cast("long").alias("cik"), name.alias("name"), F.col("date"), fits.alias("_rule"))
    # A lender's latest name is the last to be new among its names in the order of filing.
    firsts = per.where("name IS NOT NULL").groupBy("cik", "name").agg(F.min("date").alias("date"), F.min("_rule").alias("_rule"))
    found = firsts.groupBy("cik").agg(F.min("_rule").alias("_rule"), F.max_by("name", F.struct("date", "name")).alias("_last"))
    every = per.select("cik").where("cik IS NOT NULL").distinct().join(found, "cik", "left")
    rule = F.get(F.array(*[F.lit(f) for _, f in FAMILIES]), F.col("_rule"))
    return every.select("cik", F.coalesce(_lender(F.col("cik")), rule, "_last", F.col("cik").cast("string")).alias("family"))


def _lender(cik: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in LENDERS.items() for x in pair])[cik.cast("int")]


def manager(cik: Column, name: Column) -> Column:
    """The family of one lender by one name; one that fits no rule is its own."""
    rules = _first([(F.lower(name).rlike(pattern), label) for pattern, label in FAMILIES])
    return F.coalesce(_lender(cik), rules, name, cik.cast("string"))


def add_family(rows: DataFrame, found: DataFrame, cik: str = "cik", family: str = "family") -> DataFrame:
    """``rows`` with the family of their lender, unlisted ones by their number, null where there is none."""
    own = F.col(cik).cast("long")
    named = found.select(F.col("cik").alias("_cik"), F.col("family").alias("_family"))
    return rows.join(named, own == F.col("_cik"), "left").withColumn(family, F.coalesce("_family", own.cast("string"))).drop("_cik", "_family")
