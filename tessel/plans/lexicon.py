"""The lexicon of a catalog: categories with synonyms, colour families, and what excludes what.

A lexicon is a parameter of every operator that uses one.  ``DEFAULT`` has all synonyms of each category; another
one comes from a table (category, ord, synonyms, context) through ``Lexicon.from_rows``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from tessel.functions.text import stem_of

# Fixed values, in their order: (category, synonyms, context).
CATEGORIES: list[tuple[str, tuple[str, ...], str]] = [
    ("jeans", ("jean", "jeans", "denim", "denim pants", "skinny jeans", "ripped jeans", "distressed jeans"), "casual denim bottomwear"),
    ("trousers", ("trouser", "trousers", "pant", "pants", "chinos", "chino", "slacks", "formal trousers", "cargo pants", "khakis", "bottomwear"), "tailored bottomwear trousers pants"),
    ("shorts", ("short", "shorts", "bermuda", "bermudas", "cargo shorts", "denim shorts", "sweat shorts", "bottomwear"), "casual summer bottomwear shorts"),
    ("track pants", ("track pants", "track pant", "trackpants", "sweatpants", "sweat pants", "joggers", "jogger", "track trousers"), "athletic lounge bottomwear track pants"),
    ("tshirts", ("t-shirt", "t-shirts", "tshirt", "tshirts", "tee", "tees", "crewneck", "v-neck", "polo shirt", "polo", "graphic tee"), "casual topwear t-shirt"),
    ("shirts", ("shirt", "shirts", "dress shirt", "button-down", "formal shirt", "casual shirt", "oxford shirt", "topwear"), "collared button-down topwear shirt"),
    ("tops", ("top", "tops", "crop top", "blouse", "blouses", "camisole top", "peplum top", "topwear"), "women's topwear blouse top"),
    ("sweatshirts", ("sweatshirt", "sweatshirts", "hoodie", "hoodies", "pullover", "fleece", "hooded sweatshirt"), "casual warm topwear sweatshirt hoodie"),
    ("sweaters", ("sweater", "sweaters", "cardigan", "cardigans", "knitwear", "jumper", "knitted pullover"), "warm knitted winter sweater cardigan"),
    ("jackets", ("jacket", "jackets", "outerwear", "coat", "coats", "blazer", "blazers", "windbreaker", "bomber jacket", "biker jacket", "leather jacket"), "outerwear layer jacket coat"),
    ("dresses", ("dress", "dresses", "dresse", "gown", "gowns", "frock", "frocks", "one-piece", "sundress", "cocktail dress", "maxi dress", "midi dress"), "women's fashion dress gown"),
    ("kurtas", ("kurta", "kurtas", "kurti", "kurtis", "tunic", "tunics", "ethnic tunic", "anarkali"), "traditional ethnic tunic kurta"),
    ("sarees", ("saree", "sarees", "sari", "saris", "traditional sari"), "traditional ethnic draped saree"),
    ("skirts", ("skirt", "skirts", "mini skirt", "maxi skirt", "pleated skirt"), "women's bottomwear skirt"),
    ("jumpsuits", ("jumpsuit", "jumpsuits", "romper", "rompers", "dungarees", "playsuit", "one-piece suit"), "full body one-piece jumpsuit"),
    ("leggings", ("legging", "leggings", "tights", "churidar", "churidars", "jeggings", "capri", "capris"), "elastic stretch bottomwear leggings"),
    ("shoes", ("shoe", "shoes", "footwear", "sneakers", "trainers", "athletic shoes", "kicks"), "footwear shoes sneakers"),
    ("sports shoes", ("sports shoes", "running shoes", "running shoe", "trainers", "athletic footwear", "sneakers", "jogging shoes", "gym shoes"), "athletic sports running footwear"),
    ("casual shoes", ("casual shoes", "loafers", "loafer", "slip-on", "slip-ons", "boat shoes", "canvas shoes"), "everyday casual footwear shoes"),
    ("formal shoes", ("formal shoes", "oxfords", "derbys", "derby", "brogues", "leather dress shoes", "formal footwear", "monk strap"), "formal business dress footwear"),
    ("sandals", ("sandal", "sandals", "strappy sandals", "gladiator sandals", "flat sandals", "heeled sandals"), "open strap summer footwear sandals"),
    ("flip flops", ("flip flop", "flip flops", "flipflop", "flipflops", "slippers", "slipper", "slides", "thongs", "chappals"), "casual open toe flip flops slippers"),
    ("heels", ("heels", "heel", "high heels", "stilettos", "pumps", "wedges", "wedge", "heeled footwear"), "elevated heeled women's footwear"),
    ("flats", ("flats", "flat", "ballerinas", "ballerina", "loafers", "slip-ons", "flat shoes", "bellies"), "flat sole women's footwear"),
    ("socks", ("sock", "socks", "ankle socks", "crew socks", "cotton socks", "athletic socks", "hosiery"), "hosiery foot wear socks"),
    ("watches", ("watch", "watches", "watche", "timepiece", "wrist watch", "chronograph", "analog watch", "digital watch"), "wrist timepiece accessory watch"),
    ("sunglasses", ("sunglasses", "sunglass", "sunglasse", "shades", "eyewear", "sun glasses", "goggles", "aviators", "wayfarers"), "eye protection fashion eyewear sunglasses"),
    ("handbags", ("handbag", "handbags", "purse", "shoulder bag", "tote", "tote bag", "satchel", "crossbody bag", "crossbody"), "fashion accessory handbag purse"),
    ("backpacks", ("backpack", "backpacks", "rucksack", "bookbag", "travel pack", "knapsack", "laptop backpack"), "travel and utility shoulder backpack"),
    ("clutches", ("clutch", "clutches", "clutche", "clutch bag", "pouch", "evening bag", "wristlet"), "compact handheld evening clutch bag"),
    ("wallets", ("wallet", "wallets", "billfold", "coin purse", "pocketbook", "card holder", "leather wallet"), "compact pocket personal accessory wallet"),
    ("belts", ("belt", "belts", "waistband", "leather belt", "buckle belt", "strap"), "waist accessory buckle belt"),
    ("caps", ("cap", "caps", "hat", "hats", "baseball cap", "beanie", "sun hat", "headwear", "snapback"), "headwear accessory cap hat"),
    ("ties", ("tie", "ties", "necktie", "bow tie", "formal tie", "cravat"), "formal neckwear tie"),
    ("earrings", ("earring", "earrings", "studs", "hoops", "drop earrings", "danglers", "jhumkas"), "ear jewellery earrings"),
    ("necklaces", ("necklace", "necklaces", "pendant", "pendants", "chain", "chains", "locket", "choker"), "neck jewellery necklace pendant"),
    ("bracelets", ("bracelet", "bracelets", "bangle", "bangles", "wristlet", "wristband", "kada"), "wrist jewellery bracelet bangle"),
    ("rings", ("ring", "rings", "finger ring", "band", "diamond ring"), "finger jewellery ring"),
    ("cufflinks", ("cufflinks", "cufflink", "cuff links"), "formal shirt accessory cufflinks"),
    ("scarves", ("scarf", "scarves", "scarve", "stole", "stoles", "muffler", "wrap", "shawl"), "neckwear fashion accessory scarf stole"),
    ("dupattas", ("dupatta", "dupattas", "chunni", "chunari", "traditional stole"), "ethnic traditional draped dupatta"),
    ("bra", ("bra", "bras", "brassiere", "sports bra", "padded bra", "lingerie bra"), "intimate innerwear support bra"),
    ("briefs", ("brief", "briefs", "underwear", "boxers", "boxer briefs", "trunks", "underpants", "panties", "panty"), "intimate innerwear briefs underwear"),
    ("nightwear", ("nightdress", "night suit", "night suits", "nightwear", "sleepwear", "pajamas", "pyjamas", "lounge wear", "loungewear"), "comfortable sleeping lounge nightwear"),
    ("swimwear", ("swimwear", "swimsuit", "bathing suit", "swimming trunks", "bikini", "swim shorts"), "swimming athletic beach swimwear"),
    ("perfumes", ("perfume", "perfumes", "fragrance", "scent", "eau de parfum", "cologne", "body mist", "mist"), "scent fragrance perfume"),
    ("deodorants", ("deodorant", "deodorants", "body spray", "anti-perspirant", "deodorant spray", "fragrance spray"), "personal care deodorant spray"),
    ("lipstick", ("lipstick", "lipsticks", "lip color", "lip colour", "lip shade", "lip gloss", "lipgloss", "lip lacquer"), "cosmetic lip makeup lipstick"),
    ("nail polish", ("nail polish", "nail lacquer", "nail enamel", "nail paint"), "cosmetic nail care polish lacquer"),
]

# Categories whose products don't answer a query for the key.
INCOMPATIBLE: dict[str, tuple[str, ...]] = {
    "dresses": ("tshirts", "shirts", "shoes", "sports shoes", "casual shoes", "formal shoes", "watches", "handbags", "backpacks", "wallets", "belts", "perfumes", "deodorants", "jeans"),
    "tshirts": ("dresses", "formal shoes", "watches", "handbags", "backpacks", "wallets", "belts", "perfumes", "deodorants"),
    "shirts": ("dresses", "sports shoes", "handbags", "backpacks", "wallets", "belts", "perfumes", "deodorants"),
    "jeans": ("dresses", "watches", "handbags", "backpacks", "wallets", "belts", "perfumes", "deodorants"),
    "shoes": ("tshirts", "shirts", "dresses", "watches", "handbags", "backpacks", "wallets", "belts", "perfumes", "deodorants"),
    "sports shoes": ("formal shoes", "dresses", "shirts", "handbags", "watches", "wallets", "belts"),
    "formal shoes": ("sports shoes", "tshirts", "dresses", "handbags", "backpacks", "wallets", "belts"),
    "watches": ("tshirts", "shirts", "dresses", "jeans", "shoes", "handbags", "backpacks", "wallets", "belts", "perfumes", "deodorants"),
    "handbags": ("tshirts", "shirts", "dresses", "jeans", "shoes", "watches", "wallets", "belts", "perfumes", "deodorants"),
}

# Shades of each colour family; shades overlap.
COLOURS: dict[str, tuple[str, ...]] = {
    "red": ("red", "crimson", "maroon", "ruby", "burgundy", "coral", "rust"),
    "blue": ("blue", "navy", "navy blue", "cyan", "teal", "indigo", "turquoise", "cobalt"),
    "black": ("black", "charcoal"),
    "white": ("white", "off white", "ivory"),
    "green": ("green", "olive", "emerald", "lime", "khaki", "mint", "sea green"),
    "pink": ("pink", "rose", "magenta", "peach", "fuchsia", "salmon"),
    "yellow": ("yellow", "mustard", "gold", "golden", "ochre"),
    "orange": ("orange", "tangerine", "apricot", "peach"),
    "purple": ("purple", "violet", "lavender", "mauve", "plum"),
    "brown": ("brown", "tan", "chocolate", "coffee", "bronze", "copper"),
    "grey": ("grey", "gray", "silver", "steel", "gunmetal", "charcoal", "grey melange"),
    "gray": ("grey", "gray", "silver", "steel", "gunmetal", "charcoal", "grey melange"),
    "beige": ("beige", "cream", "nude", "khaki", "tan", "sand"),
    "cream": ("cream", "beige", "off white", "ivory"),
}

# Colours that a query can name; the first one found counts.
QUERY_COLOURS = (
    "red", "blue", "navy", "black", "white", "green", "yellow", "pink", "purple",
    "orange", "brown", "grey", "gray", "silver", "gold", "maroon", "beige", "cream",
)

# Things that are not in the catalog's domain.
OFF_DOMAIN = (
    "ball", "soccer ball", "football", "basketball", "tennis ball", "baseball", "volleyball",
    "golf ball", "bowling ball", "frisbee", "skateboard", "surfboard", "tennis racket", "baseball bat",
    "dog", "cat", "puppy", "kitten", "bird", "fish", "horse", "animal", "pet",
    "car", "truck", "motorcycle", "bicycle", "bike", "airplane", "boat", "vehicle",
    "food", "pizza", "burger", "apple", "banana", "sandwich",
    "laptop", "computer", "phone", "television", "tv", "camera",
)

# Strings that show that a query is about the catalog's domain after all.
IN_DOMAIN = (
    "shoe", "shoes", "sneaker", "sneakers", "boot", "boots", "sandal", "sandals", "heel", "heels", "flat", "flats",
    "shirt", "shirts", "t-shirt", "tshirt", "tshirts", "tee", "tees", "top", "tops", "blouse",
    "dress", "dresses", "gown", "gowns", "frock", "skirt", "skirts", "kurta", "kurtas", "sari", "saree",
    "pant", "pants", "jean", "jeans", "trousers", "shorts", "jacket", "jackets", "coat", "blazer",
    "watch", "watches", "bag", "bags", "handbag", "handbags", "backpack", "wallet", "belt",
    "sock", "socks", "jersey", "uniform", "wear", "apparel", "clothing", "outfit", "suit", "print", "pattern",
)

# Words for each gender, tried in this order.
GENDER_WORDS = {
    "Women": ("women", "woman", "women's", "woman's", "ladies", "lady", "female", "girls", "girl", "for her"),
    "Men": ("men", "man", "men's", "man's", "gentlemen", "male", "boys", "boy", "for him"),
    "Unisex": ("unisex",),
}

# Categories that mean women where a query names no gender.
WOMEN_BY_DEFAULT = ("dresses", "heels", "flats", "bra", "skirts", "sarees", "dupattas", "lipstick", "nail polish")

# Categories, and the master categories that their products may have.
MASTER_GROUPS: list[tuple[tuple[str, ...], tuple[str, ...]]] = [
    (("dresses", "tshirts", "shirts", "jeans", "trousers", "shorts", "skirts", "jackets", "kurtas", "sarees", "tops", "sweatshirts", "sweaters", "jumpsuits", "leggings", "nightwear", "swimwear", "bra", "briefs"), ("apparel",)),
    (("shoes", "sports shoes", "casual shoes", "formal shoes", "heels", "flats", "sandals", "flip flops"), ("footwear",)),
    (("watches", "sunglasses", "handbags", "backpacks", "wallets", "belts", "clutches", "caps", "ties", "earrings", "necklaces", "bracelets", "rings", "cufflinks", "scarves", "dupattas", "socks"), ("accessories", "bags")),
    (("perfumes", "deodorants", "lipstick", "nail polish"), ("personal care", "fragrance", "lips", "nails", "makeup")),
]


@dataclass(frozen=True)
class Category:
    name: str
    synonyms: tuple[str, ...]
    context: str

    @property
    def terms(self) -> list[str]:
        """The name and the synonyms with their stems, each once."""
        plain = [self.name, *self.synonyms]
        return list(dict.fromkeys([*plain, *map(stem_of, plain)]))


@dataclass(frozen=True)
class Lexicon:
    categories: tuple[Category, ...]
    incompatible: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: INCOMPATIBLE)
    colours: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: COLOURS)

    @classmethod
    def from_rows(cls, rows: Iterable[tuple[str, Iterable[str], str]], **more) -> Lexicon:
        return cls(tuple(Category(name, tuple(synonyms), context) for name, synonyms, context in rows), **more)

    def by_priority(self) -> list[Category]:
        """Longest name first, then in the lexicon's order."""
        return sorted(self.categories, key=lambda c: -len(c.name))

    def named(self, name: str) -> Category | None:
        return next((c for c in self.categories if c.name == name), None)


DEFAULT = Lexicon.from_rows(CATEGORIES)
