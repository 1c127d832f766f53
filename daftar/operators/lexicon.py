"""Gulf word forms and their standard counterparts, by category.

Keys are index-form tokens; values are ordinary orthography because they are embedded as text.
"""

INTERROGATIVES = {
    "شكثر": "كم", "شلون": "كيف", "منو": "من", "شنو": "ما", "وش": "ما", "وشو": "ما",
    "وين": "أين", "ليش": "لماذا", "كيفنا": "كما نشاء",
}
PARTICLES = {
    "اللي": "الذي", "عشان": "لأن", "علشان": "لأن", "ولا": "أم", "لين": "حتى", "لو": "إذا",
    "بس": "فقط", "لسا": "ما زال", "احنا": "نحن", "جوه": "داخل", "برا": "خارج",
    "الحين": "الآن", "ببلاش": "مجانا", "مو": "ليس", "مب": "ليس",
}
VERBS = {
    "ابغي": "أريد", "ابغا": "أريد", "ابي": "أريد", "يبغي": "يريد", "يبي": "يريد",
    "تبي": "تريد", "بغيت": "أردت", "ودي": "أود", "اقدر": "أستطيع", "تقدر": "تستطيع",
    "نقدر": "نستطيع", "يقدر": "يستطيع", "يقدرون": "يستطيعون", "صار": "أصبح",
    "يصير": "يصبح", "اسوي": "أفعل", "نسوي": "نفعل", "يسوون": "يفعلون", "سواها": "فعلها",
    "يدش": "يدخل", "اطفش": "أتغيب", "يطردني": "ينهي خدمتي", "يطردونه": "ينهون خدمته",
    "يطيروني": "ينهون خدمتي", "استلفت": "اقترضت",
}
NOUNS = {
    "راتب": "أجر", "راتبي": "أجري", "الراتب": "الأجر", "رواتب": "أجور", "رواتبنا": "أجورنا",
    "براتب": "بأجر", "فلوس": "مال", "فلوسي": "مالي", "فلوسه": "ماله", "شغل": "عمل",
    "الشغل": "العمل", "بالشغل": "بالعمل", "شغلي": "عملي", "دوام": "ساعات عمل",
    "الدوام": "ساعات العمل", "كفيل": "صاحب عمل", "الكفيل": "صاحب العمل",
    "لكفيلي": "لصاحب عملي", "دكتور": "طبيب", "سنين": "سنوات", "دريول": "سائق",
    "الدريول": "السائق", "خدامه": "عاملة منزلية", "الخدامه": "العاملة المنزلية",
    "للخدامه": "للعاملة المنزلية", "طياره": "طائرة", "كاش": "نقدا", "يهالي": "أطفالي",
}
CATEGORIES = {
    "interrogative": INTERROGATIVES, "particle": PARTICLES, "verb": VERBS, "noun": NOUNS,
}

# Tokens that mark a question as Gulf beyond doubt.
REGISTER_MARKERS = (
    "شكثر", "شلون", "شنو", "وش", "وشو", "منو", "وين", "ليش", "كيفنا",
    "اللي", "عشان", "علشان", "لين", "لسا", "بس", "احنا", "شوي", "خلاص",
    "يعني", "مو", "مب", "الحين", "ببلاش", "جوه", "برا", "شي",
    "ابغي", "ابغا", "ابي", "يبغي", "يبي", "تبي", "بغيت", "ودي",
    "اسوي", "نسوي", "يسوون", "سواها", "يدش", "اطفش", "يطيروني",
    "فلوس", "فلوسي", "فلوسه", "كفيل", "الكفيل", "لكفيلي",
    "دريول", "الدريول", "خدامه", "الخدامه", "للخدامه",
    "سنين", "كاش", "يهالي", "دكتور", "شغل", "الشغل", "بالشغل", "شغلي",
)

# The demonstrative clitic, the coordinating clitic and what it is not stripped from.
DEMONSTRATIVE, DEMONSTRATIVE_MIN, ARTICLE = "هال", 5, "ال"
AND = "و"
AND_BLOCKLIST = ("لو",)

# Fixed values for splitting two-part questions.
CLAUSE_STEMS = (
    "كم", "ماذا", "ما", "من", "متى", "متي", "أين", "اين", "كيف", "لماذا", "هل",
    "شكثر", "شنو", "شلون", "منو", "وين", "ليش", "ش",
)
ASKING = (
    "كم", "ماذا", "متي", "اين", "كيف", "لماذا", "هل", "شكثر", "شنو", "شلون", "منو", "وين",
    "ليش", "وش",
)
CONJUNCTIONS = ("و", "ف")
SEGMENT_TRIM = " \t\n،؛?؟"
MIN_SEGMENT_WORDS = 3
MAX_SEARCH_QUERIES = 4
