"""Headers, word lists, labels and lookup tables.

Everything here is data the results depend on, or wording shown to a reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Header in the uploaded sales file -> column.
SALES_HEADERS = {
    "Order ID": "order_id",
    "Customer Name": "customer_name",
    "Category": "category",
    "Sub Category": "subcategory",
    "City": "city",
    "State": "province",
    "Region": "region",
    "Order Date": "order_date",
    "Sales": "sales",
    "Discount": "discount",
    "Profit": "profit",
}

# Header in the uploaded review file -> column.
REVIEW_HEADERS = {
    "productId": "product_id",
    "Title": "product_name",
    "userId": "user_id",
    "Time": "review_date",
    "Score": "review_score",
    "Text": "review_text",
    "Cat1": "category",
    "Cat2": "subcategory",
    "Cat3": "product_type",
}

# Review years and categories kept or dropped by the clean step.
REVIEW_YEARS = (2015, 2016, 2017, 2018)
REBASED_YEARS = (2015, 2016, 2017)
REBASE_TARGET = 2018
REVIEW_EPOCH_ORIGIN = "1977-01-01"
EXCLUDED_REVIEW_CATEGORIES = (
    "babyproducts",
    "beauty",
    "healthpersonalcare",
    "petsupplies",
    "toysgames",
)

# Reviews that can be matched to sales.
MATCHED_REVIEW_CATEGORY = "grocerygourmetfood"
MATCHED_PRODUCT_TYPES = (
    "breadcrumbs", "breads", "breadsticks", "breakfast bakery", "cakes", "cookies",
    "fresh baked cookies", "packaged breads", "pastries", "pizza crusts", "stuffing",
    "tortillas", "cocktail mixers", "coconut water", "coffee", "energy drinks",
    "hot cocoa", "juices", "powdered drink mixes", "soft drinks", "sports drinks",
    "tea", "water", "chicken", "eggs", "seafood", "beef", "pork", "flours meals",
    "baking powder", "dried beans", "fresh fruits", "fresh vegetables", "oil", "herbs",
    "chocolate assortments", "chocolate bars", "chocolate covered fruit",
    "chocolate pretzels", "chocolate truffles",
)

# Review category -> sales category.
REVIEW_TO_SALES_CATEGORY = {
    "breads bakery": "Bakery",
    "beverages": "Beverages",
    "meat seafood": "Eggs, Meat & Fish",
    "dairy eggs": "Eggs, Meat & Fish",
    "meat poultry": "Eggs, Meat & Fish",
    "cooking baking supplies": "Food Grains",
    "produce": "Fruits & Veggies",
    "pantry staples": "Oil & Masala",
    "candy chocolate": "Snacks",
    "snack food": "Snacks",
}

# Topics and the sentences an encoder turns into topic vectors.
TOPICS = {
    "Price": "comments about price, cost, expensive, cheap, affordability, value for money",
    "Quality": "comments about quality, taste, freshness, defect, broken, damaged product",
    "Delivery": "comments about delivery, shipping, late arrival, delay, slow delivery",
    "Packaging": "comments about packaging, box, bottle, leaking, seal, damaged package",
    "Customer Service": "comments about customer service, support, refund, return, seller response",
    "Usability": "comments about using the product, instructions, setup, convenient, easy to use",
    "Availability": "comments about stock, availability, out of stock, unavailable item",
}
NO_TOPIC = "Other"

# Segment names of the month x category grid.
STRONG, RISK, OPPORTUNITY, WEAK = "Strong Performer", "Risk", "Opportunity", "Weak"
NOT_ENOUGH = "Insufficient Data"

# Published constants of the VADER sentiment rules
# (Hutto & Gilbert, ICWSM 2014).
BOOST, DAMPEN = 0.293, -0.293
NEGATION_FACTOR = -0.74
NORMALISER = 15
BOOSTERS = (
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly",
    "deeply", "effing", "enormously", "entirely", "especially", "exceptionally",
    "extremely", "fabulously", "flipping", "flippin", "fricking", "frickin",
    "frigging", "friggin", "fully", "fucking", "greatly", "hella", "highly", "hugely",
    "incredibly", "intensely", "majorly", "more", "most", "particularly", "purely",
    "quite", "really", "remarkably", "so", "substantially", "thoroughly", "totally",
    "tremendously", "uber", "unbelievably", "unusually", "utterly", "very",
)
DAMPENERS = (
    "almost", "barely", "hardly", "just enough", "kind of", "kinda", "kindof",
    "kind-of", "less", "little", "marginally", "occasionally", "partly", "scarcely",
    "slightly", "somewhat", "sort of", "sorta", "sortof", "sort-of",
)
NEGATIONS = (
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt",
    "ain't", "aren't", "can't", "couldn't", "daren't", "didn't", "doesn't", "dont",
    "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt", "neither", "don't",
    "hadn't", "hasn't", "haven't", "isn't", "mightn't", "mustn't", "neednt",
    "needn't", "never", "none", "nope", "nor", "not", "nothing", "nowhere", "oughtnt",
    "shant", "shouldnt", "uhuh", "wasnt", "werent", "oughtn't", "shan't", "shouldn't",
    "uh-uh", "wasn't", "weren't", "without", "wont", "wouldnt", "won't", "wouldn't",
    "rarely", "seldom", "despite",
)

# Our own wording. {month}, {category} and {season} are filled per row.
SEGMENT_TEXT = {
    STRONG: (
        "{category} led the pack in {month} ({season}): sales and customer mood both met or beat the median of that month.",
        "{category}, {month} ({season}): keep doing what works, hold enough stock, and repeat the promotion next {season}.",
    ),
    RISK: (
        "{category} sold well in {month} ({season}), yet customers were less happy than in the median category.",
        "{category}, {month} ({season}): read the critical reviews, look for quality or service faults, and watch whether sales follow.",
    ),
    OPPORTUNITY: (
        "{category} pleased its customers in {month} ({season}), but sold less than the median category.",
        "{category}, {month} ({season}): customers like it, so give it more visibility or a targeted campaign.",
    ),
    WEAK: (
        "{category} trailed in {month} ({season}): sales and customer mood were both under the median of that month.",
        "{category}, {month} ({season}): find the causes in sales and reviews before putting more money in.",
    ),
    NOT_ENOUGH: (
        "{category} has too little data in {month} for a reading.",
        "{category}, {month} ({season}): collect more sales and reviews before acting.",
    ),
}

# segment -> (sales level, sentiment level, zone, reading)
SEGMENT_READING = {
    STRONG: ("High", "Strong", "strong", "Sales and customer mood were both good lately."),
    RISK: ("High", "Weak", "weak", "Sales hold up, but customer mood is poor and may drag them down."),
    OPPORTUNITY: ("Moderate", "Strong", "opportunity", "Customers are content while sales still have room to grow."),
    WEAK: ("Low", "Weak", "weak", "Sales and customer mood both lag behind."),
}

# segment -> (priority, sort place, issue, benefit)
SEGMENT_ACTION = {
    RISK: ("High", 1, "Good sales with unhappy customers", "Keeps revenue and customers"),
    OPPORTUNITY: ("Medium", 2, "Happy customers with modest sales", "Opens room to grow"),
    WEAK: ("Medium", 2, "Low sales with unhappy customers", "Limits further losses"),
    STRONG: ("Low", 3, "Good sales with happy customers", "Keeps the momentum"),
}
DEFAULT_ACTION = ("Medium", 2, "Needs a closer look", "Improves the business")


def lookup_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A lookup table built from the literals above: a handful of rows, always."""
    return spark.createDataFrame(rows, schema)


def mapping_frame(spark: SparkSession, mapping: dict[str, str]) -> DataFrame:
    return lookup_frame(spark, list(mapping.items()), "from_category string, to_category string")


def segment_text_frame(spark: SparkSession) -> DataFrame:
    rows = [(name, *texts) for name, texts in SEGMENT_TEXT.items()]
    return lookup_frame(spark, rows, "segment string, insight string, recommendation string")


def segment_reading_frame(spark: SparkSession) -> DataFrame:
    rows = [(name, *values) for name, values in SEGMENT_READING.items()]
    return lookup_frame(
        spark, rows, "segment string, sales_level string, sentiment_level string, zone string, reading string"
    )


def segment_action_frame(spark: SparkSession) -> DataFrame:
    rows = [(name, *values) for name, values in SEGMENT_ACTION.items()]
    return lookup_frame(
        spark, rows, "segment string, priority string, place int, issue string, benefit string"
    )
