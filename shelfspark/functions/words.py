"""Fixed values of the product search domain (us, es, jp): words, units and patterns that results depend on, as they must match."""

# fmt: off
# Words without meaning for search.
STOPWORDS = [
    "a", "an", "and", "the", "of", "for", "with", "to", "in", "on", "by", "at", "or", "is", "are", "from", "as", "that", "this", "it", "be", "your", "you", "our", "de", "la", "el", "los", "las", "y", "con", "para", "en", "del", "un", "una", "por", "al", "o", "su", "sus", "que", "lo", "se",
]

# What is typed for a brand where there is none.
GENERIC_BRANDS = [
    "generic", "unknown", "desconocido", "no brand", "unbranded", "sin marca", "genérico", "generico", "n/a", "na", "none", "ノーブランド品", "ノーブランド", "noname", "no name", "various", "varios",
]

# Spellings of units, audiences, materials, colours and size labels, and what each stands for.
UNITS = {
    "inch": "in", "inches": "in", "in": "in", "pulgadas": "in", "pulgada": "in", "インチ": "in", '"': "in",
    "cm": "cm",
    "mm": "mm",
    "meter": "m", "meters": "m", "metro": "m", "metros": "m",
    "ft": "ft", "feet": "ft", "foot": "ft", "pies": "ft",
    "yd": "yd", "yards": "yd",
    "fl oz": "fl oz", "fl. oz": "fl oz", "floz": "fl oz", "fluid ounce": "fl oz", "fluid ounces": "fl oz",
    "oz": "oz", "ounce": "oz", "ounces": "oz", "onzas": "oz",
    "ml": "ml", "milliliter": "ml", "milliliters": "ml", "cc": "ml",
    "l": "l", "liter": "l", "liters": "l", "litre": "l", "litres": "l", "litro": "l", "litros": "l", "リットル": "l",
    "gallon": "gal", "gallons": "gal", "gal": "gal",
    "quart": "qt", "quarts": "qt", "qt": "qt",
    "lb": "lb", "lbs": "lb", "pound": "lb", "pounds": "lb", "libras": "lb",
    "kg": "kg", "kilo": "kg", "kilos": "kg", "kilogram": "kg", "kilograms": "kg",
    "g": "g", "gram": "g", "grams": "g", "gramos": "g",
    "mg": "mg",
    "gb": "gb",
    "tb": "tb",
    "mb": "mb",
    "mah": "mah",
    "w": "w", "watt": "w", "watts": "w",
    "v": "v", "volt": "v", "volts": "v",
}
AUDIENCE = {
    "men's": "men", "mens": "men", "men": "men", "hombre": "men", "hombres": "men", "caballero": "men", "メンズ": "men", "男性": "men", "紳士": "men",
    "women's": "women", "womens": "women", "women": "women", "woman": "women", "ladies": "women", "mujer": "women", "mujeres": "women", "dama": "women", "レディース": "women", "女性": "women", "婦人": "women",
    "unisex": "unisex", "ユニセックス": "unisex", "男女兼用": "unisex",
    "boys": "boys", "boy's": "boys", "boy": "boys", "男の子": "boys",
    "girls": "girls", "girl's": "girls", "girl": "girls", "niña": "girls", "niñas": "girls", "女の子": "girls",
    "kids": "kids", "kid": "kids", "children": "kids", "child": "kids", "toddler": "kids", "toddlers": "kids", "youth": "kids", "niño": "kids", "niños": "kids", "infantil": "kids", "キッズ": "kids", "子供": "kids", "子ども": "kids", "こども": "kids", "ジュニア": "kids",
    "baby": "baby", "babies": "baby", "infant": "baby", "newborn": "baby", "bebé": "baby", "bebe": "baby", "bebés": "baby", "ベビー": "baby", "赤ちゃん": "baby", "新生児": "baby",
}
MATERIALS = {
    "cotton": "cotton", "organic cotton": "cotton", "algodón": "cotton", "algodon": "cotton", "綿": "cotton", "コットン": "cotton",
    "polyester": "polyester", "poliéster": "polyester", "ポリエステル": "polyester",
    "nylon": "nylon", "nailon": "nylon", "ナイロン": "nylon",
    "spandex": "spandex",
    "leather": "leather", "genuine leather": "leather", "cuero": "leather", "piel": "leather", "本革": "leather", "革": "leather", "レザー": "leather",
    "faux leather": "faux leather", "pu leather": "faux leather", "合皮": "faux leather",
    "suede": "suede",
    "wool": "wool", "merino": "wool", "lana": "wool", "ウール": "wool",
    "silk": "silk", "seda": "silk", "シルク": "silk",
    "linen": "linen", "lino": "linen", "リネン": "linen", "麻": "linen",
    "denim": "denim",
    "fleece": "fleece",
    "stainless steel": "stainless steel", "acero inoxidable": "stainless steel", "ステンレス": "stainless steel",
    "steel": "steel", "acero": "steel",
    "aluminum": "aluminum", "aluminium": "aluminum", "aluminio": "aluminum", "アルミ": "aluminum",
    "cast iron": "cast iron",
    "iron": "iron", "hierro": "iron", "鉄": "iron",
    "copper": "copper", "cobre": "copper", "銅": "copper",
    "brass": "brass",
    "titanium": "titanium",
    "metal": "metal", "金属": "metal",
    "plastic": "plastic", "plástico": "plastic", "plastico": "plastic", "プラスチック": "plastic",
    "silicone": "silicone", "silicona": "silicone", "シリコン": "silicone", "シリコーン": "silicone",
    "rubber": "rubber", "goma": "rubber", "ゴム": "rubber",
    "wood": "wood", "wooden": "wood", "madera": "wood", "木製": "wood", "天然木": "wood",
    "bamboo": "bamboo", "bambú": "bamboo", "竹": "bamboo",
    "glass": "glass", "vidrio": "glass", "cristal": "glass", "ガラス": "glass",
    "ceramic": "ceramic", "cerámica": "ceramic", "セラミック": "ceramic", "陶器": "ceramic",
    "porcelain": "porcelain", "porcelana": "porcelain", "磁器": "porcelain",
    "stoneware": "stoneware",
    "marble": "marble",
    "canvas": "canvas",
    "paper": "paper", "papel": "paper", "紙": "paper",
    "memory foam": "memory foam",
    "foam": "foam", "espuma": "foam", "ウレタン": "foam",
    "latex": "latex",
    "acrylic": "acrylic", "acrílico": "acrylic", "アクリル": "acrylic",
    "resin": "resin", "resina": "resin", "樹脂": "resin",
    "vinyl": "vinyl",
    "pvc": "pvc",
    "carbon fiber": "carbon fiber",
    "sterling silver": "sterling silver",
    "14k gold": "gold", "18k gold": "gold", "10k gold": "gold",
}
COLOURS = {
    "black": "black", "negro": "black", "negra": "black", "ブラック": "black",
    "white": "white", "blanco": "white", "blanca": "white", "ホワイト": "white",
    "red": "red", "rojo": "red", "roja": "red", "レッド": "red",
    "navy blue": "navy", "navy": "navy", "azul marino": "navy", "ネイビー": "navy",
    "blue": "blue", "azul": "blue", "ブルー": "blue",
    "green": "green", "verde": "green", "グリーン": "green",
    "yellow": "yellow", "amarillo": "yellow", "amarilla": "yellow", "イエロー": "yellow",
    "pink": "pink", "rosa": "pink", "ピンク": "pink",
    "purple": "purple", "morado": "purple", "morada": "purple", "violeta": "purple", "lila": "purple", "パープル": "purple",
    "orange": "orange", "naranja": "orange", "オレンジ": "orange",
    "brown": "brown", "marrón": "brown", "marron": "brown", "ブラウン": "brown",
    "gray": "gray", "grey": "gray", "gris": "gray", "グレー": "gray", "グレイ": "gray",
    "silver": "silver", "plateado": "silver", "plata": "silver", "シルバー": "silver",
    "gold": "gold", "dorado": "gold", "ゴールド": "gold",
    "beige": "beige", "ベージュ": "beige",
    "clear": "clear", "transparente": "clear", "クリア": "clear", "透明": "clear",
    "multicolor": "multicolor", "multi-color": "multicolor", "multicolour": "multicolor", "マルチカラー": "multicolor",
    "rose gold": "rose gold",
}
SIZES = {
    "x-small": "xs",
    "small": "small", "pequeño": "small", "pequeña": "small",
    "medium": "medium", "mediano": "medium", "mediana": "medium",
    "large": "large", "grande": "large",
    "x-large": "xl", "xl": "xl", "extra grande": "xl",
    "xx-large": "xxl", "xxl": "xxl", "2xl": "xxl",
    "xxx-large": "xxxl", "xxxl": "xxxl", "3xl": "xxxl",
    "4xl": "4xl",
    "5xl": "5xl",
    "queen size": "queen", "queen": "queen",
    "king size": "king",
    "california king": "california king", "cal king": "california king",
    "twin xl": "twin xl",
    "twin size": "twin",
    "full size": "full",
}

# Words behind the number of a pack, words a stated fit doesn't begin with.
COUNT_WORDS = [
    "pack", "pk", "packs", "count", "ct", "pcs", "pc", "pieces", "piece", "pairs", "pair", "rolls", "sheets", "piezas", "pieza", "unidades", "uds", "pares", "paquetes", "bolsas",
]
COUNT_CJK = [
    "個入り", "本入り", "枚入り", "袋入り", "個セット", "本セット", "枚セット", "個", "枚", "本", "袋", "足", "組", "セット", "パック", "入り",
]
COMPAT_STOP = [
    "most", "all", "up", "any", "over", "in", "perfectly", "well", "comfortably", "true", "snugly", "securely", "easily", "into", "on", "under", "a", "the", "your", "you", "standard", "almost", "many", "nearly", "both", "for", "with", "to", "and", "el", "la", "los", "las", "tu", "su",
]

# Patterns.
NEGATION = r'(?U)\b(?:without|w/o|not|non|no|sin|except|excluding|free of)\b|なし|無し|不要|以外'
NEGATED = r'(?U)\b(?:without|w/o|no|non|not|sin|except|excluding|free of)\b\s+((?:\p{L}{2,}\s?){1,2})'
PACK_OF = r'(?:pack|set|box|case|bag|lot|bundle) of \d+|(?:paquete|juego|lote|set|pack) de \d+'
COMPAT_WITH = r'(?:compatible with|compatible con|compatible para|designed for|replacement for|for use with|fits)\s+([a-z0-9][a-z0-9 .+\-]{1,40})'
COMPAT_JP = r'([a-z0-9][a-z0-9 .+\-]{2,30}?)\s*(?:対応|専用|用)'
STATED_SIZE = r"(?:size|talla)\s*:?\s*(\d{1,2}(?:\.5)?|xx?s|x{0,3}l|[sml])\b"
STATED_SIZE_JP = r"(?:^|[^a-z])(xs|s|m|l|ll|xl|xxl|3l)\s*サイズ"
CJK = "々〆぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿"
ENTITIES = {"&amp;": "&", "&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&lt;": "<", "&gt;": ">", "&#34;": '"'}
# fmt: on
