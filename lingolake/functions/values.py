"""Fixed values of the transcript operators: patterns, word lists and limits that results depend on."""

from __future__ import annotations

import re

# Ends of sentences, emphatic ends, ends and breaks inside them, a bracketed label at a text's start.
SENTENCE_END = r"[.!?…。！？][\"”’)\]]*$"
LONG_END = r"(?:[!?…！？]|\.\.\.)[\"”’)\]]*$"
SENTENCE_BREAK, CLAUSE_BREAK = r"(?<=[.!?…])\s+", r"(?<=[,;:])\s+"
SOURCE_BOUNDARY = r"[。！？!?；，;,:：\s]+[”’\"）)]*"
LABEL = r"(?U)^\s*[\[【][^\]】\n]{1,40}[\]】]"

# What is masked in messages.
MASK_URL = r"(?U)https?://[^\s]+"
MASK_LINE = r"(?im)^.*(?:cookie|authorization|bearer|password|secret|token|api[_-]?key|\bSID=|\bSAPISID=).*$"
MASK_PAIR = r"(?U)\b[\w-]{2,}=[^\s;,]+"

# Words by which a failure is known.
LICENCE_CODES = ["UNACTIVATED", "EXPIRED", "CLOCK_ROLLBACK", "TRUSTED_TIME_UNAVAILABLE", "WRONG_MACHINE", "INVALID", "RENEWAL_REQUIRED", "VOICE_MISSING"]
DISK_WORDS = ["no space left", "disk full"]
DEVICE_WORDS = ["cuda", "not compiled with", "invalid device"]
SIGN_IN_WORDS = ["cookie", "sign in", "xác thực"]
TOOL_WORDS = ["ffmpeg", "ffprobe"]
MODEL_WORDS = ["model", "vieneu", "trọng số", "tokenizer", "weights"]
MISSING_WORDS = ["not found", "không tìm", "load"]
SETTING_WORDS = ["invalid literal", "environment", "device", "batch", "results_root"]

# Third-person singular forms and their genders.
MALE_FORMS = ["anh ấy", "anh ta", "ông ấy", "ông ta", "cậu ấy", "cậu ta", "hắn", "gã"]
FEMALE_FORMS = ["cô ấy", "cô ta", "chị ấy", "chị ta", "bà ấy", "bà ta", "ả"]
OPEN_FORMS = ["người ấy", "em ấy"]

# What a form of one gender becomes in the other.
TO_FEMALE = {"anh ấy": "cô ấy", "anh ta": "cô ta", "ông ấy": "bà ấy", "ông ta": "bà ta", "cậu ấy": "cô ấy", "cậu ta": "cô ta", "hắn": "cô ta", "gã": "ả"}
TO_MALE = {"cô ấy": "anh ấy", "cô ta": "anh ta", "chị ấy": "anh ấy", "chị ta": "anh ta", "bà ấy": "ông ấy", "bà ta": "ông ta", "ả": "hắn"}

# Gendered nouns near a source pronoun.
MALE_NOUNS = "哥|爸|弟|叔|爷|父亲|儿子|男友|男朋友|男人|男孩|男生(?!宿舍)|老公|丈夫|帅哥|小伙"
FEMALE_NOUNS = "妈|姐|妹|姨|婆|嫂|母亲|女儿|女友|女朋友|女人|女孩|女生|老婆|妻|闺蜜|姑娘|美女"

# Singular and plural source pronouns, one that ends a row, a bare call at a row's start, the vocative and its compounds.
PRONOUN, PLURAL_PRONOUN = "[他她](?!们)", "[他她]们"
LAST_PRONOUN = r"(?U)[他她][，,。！!？?…\s]*$"
CALL = r"(?U)^\s*([^，,！!。？?\s]{1,6}?)[啊呀]?[，,！!]"
YOU = r"(?iU)(?<!\w)(?<!các )(?<!những )(?<!người )bạn(?! (?:trai|gái|bè|cùng|học|thân|đời|đồng)\b)(?!\w)"

# Cues and name characters from which a gender is inferred.
FEMALE_CUES = ["女", "妈", "姐", "妹", "姨", "婆", "嫂", "媳", "妻", "老婆", "姑娘", "美女", "小姐", "闺蜜"]
MALE_CUES = ["男", "爸", "哥", "弟", "叔", "爷", "夫", "老公", "先生", "帅", "兄"]
FEMALE_NAME_CHARS = "淑婷娟丽倩芳娜敏静燕艳玲霞琳雪梅兰莉萍红慧颖琪瑶怡欣蕾薇媛婉妍晶洁菲露凤秀珍莹璐彤悦诗雯瑜念娇姗嫣婕茜"
MALE_NAME_CHARS = "强伟刚勇军杰涛斌浩鹏辉磊超峰龙豪毅健波鑫凯俊博雄彪虎栋坤森宏亮"
FEMALE_TARGET = ["cô ấy", "cô ta", "chị ấy", "chị ta", "bà ấy", "bà ta", "cô gái", "người phụ nữ"]
MALE_TARGET = ["anh ấy", "anh ta", "ông ấy", "ông ta", "cậu ấy", "cậu ta", "hắn", "chàng trai", "người đàn ông"]

# Kinship terms of the narrator: aliases, target, gender, rank, forms (third, you).
KIN = [
    (["我妈", "妈妈", "母亲", "我母亲", "咱妈"], "mẹ", "female", "elder", "mẹ", "mẹ"),
    (["我爸", "爸爸", "父亲", "我父亲", "咱爸"], "bố", "male", "elder", "bố", "bố"),
    (["奶奶", "外婆", "姥姥"], "bà", "female", "elder", "bà", "bà"),
    (["爷爷", "外公", "姥爷"], "ông", "male", "elder", "ông", "ông"),
    (["我哥", "哥哥"], "anh trai", "male", "senior", "", ""),
    (["我姐", "姐姐"], "chị gái", "female", "senior", "", ""),
    (["我弟", "弟弟"], "em trai", "male", "junior", "", ""),
    (["我妹", "妹妹"], "em gái", "female", "junior", "", ""),
    (["嫂子", "我嫂子", "大嫂"], "chị dâu", "female", "senior", "", ""),
    (["姐夫"], "anh rể", "male", "senior", "", ""),
    (["婆婆"], "mẹ chồng", "female", "elder", "", ""),
    (["公公"], "bố chồng", "male", "elder", "", ""),
    (["岳母", "丈母娘"], "mẹ vợ", "female", "elder", "", ""),
    (["岳父", "老丈人"], "bố vợ", "male", "elder", "", ""),
]

# Forms of address by role.gender.rank or role.gender: third person, vocative.
ROLES = ["narrator", "family", "lover", "friend", "antagonist", "other"]
RANKS = ["elder", "senior", "peer", "junior"]
ADDRESS_BASE = {
    "other.male.elder": ("ông ấy", "ông"),
    "other.female.elder": ("bà ấy", "bà"),
    "other.male.senior": ("anh ấy", "anh"),
    "other.female.senior": ("chị ấy", "chị"),
    "other.male.peer": ("anh ấy", "anh"),
    "other.female.peer": ("cô ấy", "cô"),
    "other.male.junior": ("cậu ấy", "cậu"),
    "other.female.junior": ("cô bé", "em"),
    "family.male.elder": ("ông", "ông"),
    "family.female.elder": ("bà", "bà"),
    "family.male.senior": ("anh ấy", "anh"),
    "family.female.senior": ("chị ấy", "chị"),
    "family.male.peer": ("anh ấy", "anh"),
    "family.female.peer": ("cô ấy", "em"),
    "family.male.junior": ("em ấy", "em"),
    "family.female.junior": ("em ấy", "em"),
    "lover.male": ("anh ấy", "anh"),
    "lover.female": ("cô ấy", "em"),
    "friend.male.peer": ("cậu ấy", "cậu"),
    "friend.female.peer": ("cô ấy", "cậu"),
    "antagonist.male.elder": ("ông ta", "ông"),
    "antagonist.female.elder": ("bà ta", "bà"),
    "antagonist.male.senior": ("anh ta", "anh"),
    "antagonist.female.senior": ("chị ta", "chị"),
    "antagonist.male.peer": ("anh ta", "anh"),
    "antagonist.female.peer": ("cô ta", "cô"),
    "antagonist.male.junior": ("cậu ta", "cậu"),
    "antagonist.female.junior": ("cô ta", "cô"),
}
ADDRESS_PROFILES = {
    "neutral": (False, {}),
    "drama": (True, {}),
    "survival": (True, {
        "antagonist.male.senior": ("hắn", "mày"),
        "antagonist.male.peer": ("hắn", "mày"),
        "antagonist.male.junior": ("hắn", "mày"),
        "antagonist.female.peer": ("cô ta", "mày"),
        "antagonist.female.junior": ("cô ta", "mày"),
    }),
    "rebirth": (True, {
        "antagonist.male.peer": ("hắn", "anh"),
        "antagonist.male.junior": ("hắn", "cậu"),
        "friend.male.peer": ("cậu ấy", "cậu"),
    }),
}

# What model output must not contain.
CONTROL_TOKENS = ["<think>", "</think>", "<|im_", "<｜hy_", "<|eos|>", "<|extra_", "<|startoftext|>"]
PROMPT_LABELS = ["[Background Information]", "[Source Text]", "[Draft to correct]", "[Thông tin cơ bản]", "[Thông tin nền]", "[Văn bản nguồn]"]

# Standalone interjections.
LAUGHS = r"(?:ha(?:[ -]?ha)+|hà(?:[ -]?hà)+|hô(?:[ -]?hô)+|he(?:[ -]?he)+|hi(?:[ -]?hi)+|hì(?:[ -]?hì)+|khà(?:[ -]?khà)+|khì(?:[ -]?khì)+)"
SIGHS = r"(?:hai+z+|ai+z+|hầy+|haizz+|ai da|hây da)"

# Source cleanup: marks that alone make no row, and marks that may end one.
ONLY_MARKS = re.compile(r"[\s，,。．.！!？?、；;：:…“”\"'‘’（）()]*")
ROW_ENDS = "。！？!?…，,"
BOILERPLATE = [r"(?:好看小?[，,。\s]*)*小说千千万[，,。\s]*悠悠[，,。\s]*这里占一半[，,。\s]*连好\s*wifi[，,。\s]*备好瓜子饮料[，,。！!\s]*精彩故事[，,。\s]*现在开始[，,。！!\s]*"]
CORRECTIONS = [("煤运", "霉运"), ("苦苦婆心", "苦口婆心"), ("撒比", "傻逼"), ("全闻完", "全文完")]

# Narration styles: gap, long gap, whether interjections become cues.
STYLES = {"rebirth": (420, 1000, True)}
