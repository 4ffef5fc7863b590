"""Lookup tables as data. Callers may pass their own to every function that takes one."""

# Terms, aliases, labels and patterns whose spelling decides results.
SYNONYMS = {
    "নাবী ধ্বসা": ["মড়ক", "লেইট ব্লাইট", "late blight"],
    "আগাম ধ্বসা": ["আর্লি ব্লাইট", "early blight"],
    "পাতা ঝলসানো": ["লিফ স্কাল্ড", "leaf scald"],
    "ব্যাকটেরিয়াল ব্লাইট": ["পাতা পোড়া রোগ", "bacterial blight"],
    "টুংরো": ["tungro"],
    "ব্লাস্ট": ["blast"],
    "বাদামী দাগ": ["brown spot"],
}
WEATHER = "আবহাওয়া|আবহাওয়া|বৃষ্টি|তাপমাত্রা|রোদ|abohawa|brishti|bristi|tapmatra|rod|weather|rain|temperature|forecast"
PRICE = (
    "দাম|মূল্য|বাজারদর|বাজার দর|দর কত|bazar[ \\t]*dor|bazardor|bajar[ \\t]*dor|bajardor|dam|daam|mullo|price|market rate|market price"
)
ADVICE = (
    "রোগ|পোকা|কীট|ব্লাইট|দাগ|পাতা|চাষ|সার|কীটনাশক|প্রতিকার|চিকিৎসা|স্প্রে|লক্ষণ|করণীয়|করনীয়|"
    "disease|pest|blight|symptom|treatment|fertilizer|spray|cultivation|how to|what should|rog|poka|kit|dag|pata|chash|"
    "sar|kitnashok|protikar|chikitsa|lokkhan|koronio|koroniyo|doman|protirodh|kivabe|ki korbo|debo|dite hobe"
)
GREETINGS = (
    "হ্যালো|হাই|ধন্যবাদ|থ্যাঙ্কস|dhonnobad|donnobad|বিদায়|বিদায়|বাই|আবার দেখা হবে|hello|hi|thanks|thank you|bye|goodbye|"
    "ok|okay|ঠিক আছে|শুভ দিন|শুভরাত্রি|শুভ রাত্রি"
)
#: In this order: the first that occurs is a text's crop.
CROPS = {
    "potato": "আলু|potato|alu",
    "tomato": "টমেটো|tomato|tometo",
    "rice": "ধান|চাল|rice|dhan|chal",
    "onion": "পেঁয়াজ|পেঁয়াজ|পিয়াজ|পিয়াজ|onion|peyaj|piyaj",
    "garlic": "রসুন|garlic|roshun|rosun",
    "masur dal": "মসুর(?:[ \\t]+ডাল)?|masur[ \\t]+dal|masur|lentil",
    "ginger": "আদা|ginger|ada",
    "green chili": "কাঁচা[ \\t]+মরিচ|কাচা[ \\t]+মরিচ|green[ \\t]+chil(?:i|li)|kacha[ \\t]+morich|morich",
}
DIVISIONS = {
    "ঢাকা": "ঢাকা", "dhaka": "ঢাকা",
    "চট্টগ্রাম": "চট্টগ্রাম", "চট্টগ্রামে": "চট্টগ্রাম", "chattogram": "চট্টগ্রাম", "chittagong": "চট্টগ্রাম",
    "খুলনা": "খুলনা", "khulna": "খুলনা",
    "রাজশাহী": "রাজশাহী", "rajshahi": "রাজশাহী",
    "বরিশাল": "বরিশাল", "barishal": "বরিশাল", "barisal": "বরিশাল",
    "সিলেট": "সিলেট", "sylhet": "সিলেট",
    "রংপুর": "রংপুর", "rangpur": "রংপুর",
    "ময়মনসিংহ": "ময়মনসিংহ", "ময়মনসিংহ": "ময়মনসিংহ", "mymensingh": "ময়মনসিংহ",
}
INJECTIONS = (
    "ignore (all |any |the )?(previous |above |prior )?instructions",
    "you are now",
    "system prompt",
    "disregard (the )?(system|previous)",
    "act as (if )?(a|an)[ \\t\\n]",
    "পূর্ববর্তী নির্দেশ.{0,20}উপেক্ষা",
)
HEDGES = ("সম্ভবত", "হতে পারে", "মনে হচ্ছে", "confidence", "নিশ্চিত না", "%")
#: (pattern, replacement), applied in this order; $1 is the text between.
OVERCLAIMS = (
    ("অবশ্যই([^।!?]{0,20})(আছে|হয়েছে|হয়|করেছে)", "সম্ভবত$1থাকতে পারে"),
    ("নিশ্চিতভাবে([^।!?]{0,20})(এটি|এই)", "এটি সম্ভবত$1"),
    ("১০০[ \\t]*%[ \\t]*নিশ্চিত", "প্রাথমিকভাবে অনুমিত"),
    ("অবশ্যই আপনার", "সম্ভবত আপনার"),
    ("নিশ্চিতভাবে এটি", "এটি সম্ভবত"),
)
#: (unit, words of a cell that mean it, or a pattern of the whole cell), the first that fits.
UNITS = (
    ("প্রতি লিটার", ("লিটার", "নিটার", "লিট", "নিট", "তিটার", "রিটার", "রিটারি", "লি.")),
    ("প্রতি হালি", ("হালি", "হোলি")),
    ("প্রতি গ্রাম", ("গ্রাম", "গ্োরোম")),
    ("প্রতিটি", "^(?:(?:[0-9]+ *)?টি|(?:প্রতি|প্রনি|প্রতিটি|প্রনিটি) *টি)$"),
    ("প্রতি কেজি", ("কেজি", "কেতি", "কেনি", "কেজ")),
)
# Words by which rows of market tables are read.
UNIT_MARKS = (
    "কেজি", "কেতি", "কেনি", "কেজ", "কেলি", "বেরি", "লিটার", "নিটার", "লিট", "নিট", "তিটার", "রিটার", "রিটারি", "লি.", "হালি", "হোলি", "গ্রাম",
)
HEADER_NOISE = ("পরের নাম", "পণ্যের নাম", "পরের িোম", "পলেি নাম", "পতরমাপ", "পরের প্রকার", "পণ্যের প্রকার", "পনরমাপ", "পনরমোপ", "পরিমাপ")
DITTO = ("", ",,", '"', "”", "''", '""')
QUALIFIERS = (
    "খোলা", "প্যাকেট", "দেশী", "দেশি", "চায়না", "আমদানিকৃত", "উন্নত", "মোটা", "সরু", "চাষের", "জীবন্ত", "সোনালী", "ব্রয়লার", "লম্বা", "জালি",
    "সাদা", "ক্যান",
)
PULSES = ("ডাল", "মসুর ডাল", "মুগ ডাল")
PULSE_NAMES = ("মসুর", "মুগ", "মাষকলাই", "কেসারি")
OWN_UNITS = {"লাউ": "প্রতিটি", "চালকুমড়া": "প্রতিটি"}
OILS = ("সয়াবিন তেল", "পাম তেল", "সরিষার তেল", "তেল (", "তেল-")
#: Eggs are asked for before flesh, so the two lists are apart.
EGGS = ("ডিম",)
FLESH = ("মাছ", "রুই", "কাতলা", "পাঙ্গাস", "তেলাপিয়া", "ইলিশ", "মুরগি", "মোরগ", "গরু", "ছাগল", "মাংস", "মোংস")
BY_PIECE = ("কলা", "লাউ", "চালকুমড়া")
CONFIDENT = (
    "আটা", "মসুর", "মুগ", "ডাল", "কেসারি", "ছোলা", "তেল", "চিনি", "পেঁয়াজ", "রসুন", "আদা", "মরিচ", "আলু", "বেগুন", "পেঁপে", "কুমড়া", "চিচিঙ্গা",
    "ধুন্দুল", "কচু", "বরবটি", "লাউ", "চালকুমড়া", "শসা", "উচ্ছে", "করল্লা", "ঝিঙ্গা", "ঢেঁড়স", "পটল", "ফুলকপি", "বাঁধাকপি", "মূলা", "মুলা", "শিম",
    "চাল", "ধান", "লবণ", "দুধ", "আপেল", "পেয়ারা", "আম", "কলা", "মাছ", "রুই", "কাতলা", "ইলিশ", "পাঙ্গাস", "তেলাপিয়া", "মাংস", "গরু", "ছাগল",
    "মুরগি", "মোরগ", "ডিম", "ব্রয়লার",
)
ROOTS = (
    "আটা", "মসুর", "মুগ", "মাষকলাই", "কেসারি", "ছোলা", "সয়াবিন", "পাম", "সরিষার", "চিনি", "পেঁয়াজ", "রসুন", "আদা", "মরিচ", "আলু", "বেগুন", "পেঁপে",
    "কুমড়া", "চিচিঙ্গা", "ধুন্দুল", "কচু", "বরবটি", "লাউ", "চালকুমড়া", "শসা", "উচ্ছে", "করল্লা", "ঝিঙ্গা", "ঢেঁড়স", "পটল", "চাল", "আপেল", "পেয়ারা",
    "আম", "কলা", "মাছ", "রুই", "কাতলা", "ইলিশ", "পাঙ্গাস", "তেলাপিয়া", "মাংস", "গরু", "ছাগল", "মুরগি", "মোরগ", "ডিম",
)
#: root -> the qualifiers it may have
ALLOWED = {"আটা": ("প্যাকেট-সাদা", "প্যাকেট", "খোলা"), "রসুন": ("দেশী", "দেশি")}
#: A name that begins with the first is kept only with the second.
ONLY_WITH = {"রসুন": "দেশী"}
#: Words of headers that name current prices, and of those that compare.
CURRENT = ("আজ", "আির", "আদর", "র্াজার", "বাজার", "সর্বনিম্ন")
COMPARED = ("সাথে", "হ্রাস", "বৃদ্ধি", "%", "গি ম", "গি র")
#: Of those the ones that count where no header names current prices.
COMPARED_SURELY = ("সাথে", "হ্রাস", "বৃদ্ধি", "%")
#: Whole cells that are units of pieces or litres, as reports spell them.
UNIT_CELLS = (
    "(?:[0-9]+[ \\t]*)?টি",
    "(?:প্রতি|প্রনি|প্রতিটি|প্রনিটি)[ \\t]*টি",
    "(?:[0-9]+[ \\t]*)?(?:লি[.]?|লিটার|নিটার|তিটার|রিটার|রিটারি|বেরি)",
)
#: Fixed value: the division of questions that name none.
DEFAULT_DIVISION = "ঢাকা"
#: Fixed values: (pattern, replacement) that names are repaired by, in this order.
NAME_REPAIRS = (
    ("^রুই মা(?=[ ]|$)", "রুই মাছ"),
    ("[ \\t]+", " "),
    ("ডাল(?: ডাল)+", "ডাল"),
    (" *- *\\(", " ("),
    (" *\\( *", " ("),
    (" *\\)", ")"),
    ("^রসুন *\\(ি[^()]*\\)$", "রসুন (চায়না)"),
    ("^(রুই মাছ \\(চাষের\\)).*$", "$1"),
    (" */ *", " / "),
    ("([\\u0980-\\u09FF)])(?=[0-9])", "$1 "),
)
#: Names of crops.
CROP_LABELS = {
    "potato": "আলু", "onion": "পেঁয়াজ", "masur dal": "মসুর ডাল", "tomato": "টমেটো", "garlic": "রসুন", "ginger": "আদা",
    "green chili": "কাঁচা মরিচ", "rice": "চাল",
}
#: Class -> (crop, name, query), and what stands for unknown classes.
CLASSES = {
    "rice_brown_spot": ("ধান", "বাদামী দাগ রোগ", "ধানের বাদামী দাগ রোগ প্রতিকার"),
    "rice_leaf_scald": ("ধান", "পাতা ঝলসানো রোগ (লিফ স্কাল্ড)", "ধানের পাতা ঝলসানো রোগ প্রতিকার"),
    "rice_blast": ("ধান", "ব্লাস্ট রোগ", "ধান ব্লাস্ট রোগ প্রতিকার"),
    "rice_tungro": ("ধান", "টুংরো রোগ", "ধানের টুংরো রোগ প্রতিকার"),
    "rice_bacterial_blight": ("ধান", "ব্যাকটেরিয়াল ব্লাইট (পাতা পোড়া রোগ)", "ধানের ব্যাকটেরিয়াল ব্লাইট রোগ প্রতিকার"),
    "potato_early_blight": ("আলু", "আগাম ধ্বসা রোগ", "আলুর আগাম ধ্বসা রোগ প্রতিকার"),
    "potato_late_blight": ("আলু", "নাবী ধ্বসা রোগ", "আলুর নাবী ধ্বসা রোগ প্রতিকার"),
    "potato_healthy": ("আলু", "সুস্থ গাছ", "আলু গাছের যত্ন ও পরিচর্যা"),
    "tomato_early_blight": ("টমেটো", "আগাম ধ্বসা রোগ", "টমেটোর আগাম ধ্বসা রোগ প্রতিকার"),
    "tomato_late_blight": ("টমেটো", "নাবী ধ্বসা রোগ", "টমেটোর নাবী ধ্বসা রোগ প্রতিকার"),
    "tomato_healthy": ("টমেটো", "সুস্থ গাছ", "টমেটো গাছের যত্ন ও পরিচর্যা"),
}
NO_CLASS = ("অজানা", "সনাক্ত করা যায়নি", "ফসলের রোগ সনাক্তকরণ ও প্রতিকার")
#: A script's characters, and Latin with the accents of western Europe.
BANGLA = "ঀ-৿"
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: What services say of replies that were cut off, and the marks that whole replies end with.
CUT_OFF = ("LENGTH", "MAX_TOKENS", "MAXTOKENS", "TOKEN_LIMIT")
CLOSING_MARKS = ".!?।॥:;)]}»”\"'’"
