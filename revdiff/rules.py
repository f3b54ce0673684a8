"""Rule presets: marker lists, look-alike letters and labels for Russian design documents.

Every operator takes its rules as arguments; the values here are only the default preset.
All of them are fixed values: they must keep this exact spelling for the results to agree.
"""

# ---- fixed values: letters that look alike (Cyrillic, Latin) ------------------------------
LOOKALIKE_COMPARE = ("АВЕКМНОРСТУХавекмнорстух", "ABEKMHOPCTYXabekmhopctyx")
LOOKALIKE_CONNECTOR = ("АВЕКМНОРСТХавекмнорстх", "ABEKMHOPCTXABEKMHOPCTX")
LOOKALIKE_DIAGRAM = ("ХхРрТтСс", "XxPpTtSs")

# ---- fixed values: document types, suffixes -----------------------------------------------
TYPE_ASSEMBLY = "Сборочный чертеж"
TYPE_WIRING = "Схема электрическая соединений"
TYPE_ELEMENTS = "Перечень элементов"
TYPE_BOM = "Спецификация"
TYPE_UNKNOWN = "Не определён"
SUFFIXES = ("СБ", "СП", "ПЭ4", "Э4")

# ---- fixed values: marker words -----------------------------------------------------------
TITLE_BLOCK_WORDS = (
    "разраб", "пров", "н. контр", "т. контр", "утв", "лист", "листов", "масса", "масштаб",
    "лит", "формат", "подп", "дата", "изм", "инв", "зам", "перв", "справ", "копировал",
    "стадия", "докум", "см.", "см",
)
BOM_SECTIONS = (
    "документация", "комплекты", "сборочные единицы", "детали", "стандартные изделия",
    "прочие изделия", "материалы",
)
BOM_HEADER_WORDS = ("формат", "зона", "поз", "обознач", "наимен", "кол", "примеч")
BOM_TABLE_ALL = ("обознач", "наимен", "кол")
BOM_TABLE_ANY = ("документац", "материал", "прочие изделия")
ELEMENT_HEADER_WORDS = ("поз", "обознач", "наимен", "кол", "примеч")
DATA_TABLE_HEADERS = (
    "провод", "поз", "от соединителя", "к соединителю", "обозначение", "длина", "кол",
    "позиционное обозначение", "маркировка", "код", "масса", "xp1", "xs1", "xs2",
)
DATA_TABLE_NAMES = ("таблица", "маркировка", "провод", "поз")
NUMERIC_NAME_HEADERS = (
    "провод", "поз", "от соедин", "к соедин", "обознач", "длина", "кол", "маркиров", "код", "масса",
)
NOISE_MARKERS = ("п.", "l=", "экран", "gnd", "s1", "s2", "xs", "xp", "xt", "x1", "x2")
SERVICE_LINES_EXACT = (
    "дата", "и", "подп.", "№", "инв.", "дубл.", "справ.", "перв.", "примен.", "подл.", "взам.",
)
BOM_SERVICE_CONTAINS = (
    "подп.", "инв.", "взам.", "дубл.", "формат а4", "копировал", "создал:", "по эси:",
    "разраб.", "пров.", "н.контр.", "утв.",
)
BOM_SERVICE_EXACT = SERVICE_LINES_EXACT + ("лит. лист листов", "лист", "листов")
ELEMENT_SERVICE_CONTAINS = (
    "разраб.", "пров.", "н.контр.", "утв.", "подп.", "дата", "инв.", "взам.", "дубл.",
    "копировал", "формат а4", "справ. №", "ао ",
)
TABLE_ROW_SERVICE = ("изм.", "лист", "№ докум.", "подп.", "дата")
HEADER_WORDS_EXACT = (
    "поз", "поз.", "провод", "провода", "маркировка", "код", "кол", "кол.", "длина", "длина,мм",
    "обозначение", "обозначениепровода/кабеля", "отсоединителя", "ксоединителю",
    "позиционноеобозначение", "соединитель", "исполнение", "исп.", "наименование", "примечание",
)
BAD_SUBJECTS_EXACT = HEADER_WORDS_EXACT + ("-", "—", "–")
HEADER_DEPTH_WORDS = (
    "обозначение", "код", "маркировка", "масса", "лист", "листы", "l, мм", "l1, мм", "l2, мм",
    "n, шт", "формат", "зона", "поз.", "позиция", "наименование", "кол.", "кол", "примечание",
    "провод", "от соединителя", "к соединителю", "длина",
)
UNNUMBERED_SUBJECTS = ("бн", "безномера")
FILL_COLUMNS = (
    "поз", "от соедин", "к соедин", "обозначение провода", "обозначение кабеля", "длина",
    "маркиров", "позиционное обозначение",
)
# key column: marker groups in falling priority; a group's first matching column wins
KEY_COLUMN_MARKERS = (
    ("провод", "номер провода", "№ провода", "n провода"),
    ("исполнение", "исп"),
    ("позиционное обозначение", "поз обозначение", "поз. обозначение"),
    ("соединитель",),
    ("код",),
    ("поз",),
    ("номер",),
    ("обозначение",),
)
KEY_COLUMN_EXCLUDED = ("обозначение провода", "обозначение кабеля")
# item-table columns by header marker
ITEM_COLUMNS = (
    ("format", "формат"), ("zone", "зона"), ("position", "поз"), ("designation", "обознач"),
    ("name", "наимен"), ("quantity", "кол"), ("note", "примеч"),
)
GARBAGE_MARKERS = (
    ".лбуд", ".мазв", ".лдоп", "йоколоворп", "ьтаворижаднаб", ").replace", "replace(»,",
    "мцша.101.19128.006.00 жгут", ".82191.101", "00.000",
)
GARBAGE_NEW_ROW_EXCEPTIONS = (
    "труб", "провод", "кабель", "плетен", "розетка", "соединитель", "кожух", "наконечник", "профиль",
)
UNQUANTIFIED_NAMES = ("соединитель", "розетка", "вилка", "кожух", "наконечник", "пробка")
SENSITIVE_KEY_PARTS = (
    "secret", "token", "password", "passwd", "pwd", "client_id", "authorization", "api_key",
    "apikey", "key",
)
BAD_CODE_LETTERS = (
    "ЗАМ", "ИЗМ", "ЛИТ", "ЛИТЕРА", "ЛИСТ", "ЛИСТОВ", "МАСШТАБ", "МАССА", "ДАТА", "ДОКУМ", "ДОК",
    "ПОДП", "РАЗРАБ", "ПРОВ", "УТВ", "КОНТР", "ТКОНТР", "НКОНТР", "ТТ", "СМ", "СМТТ", "СМТАБЛ",
    "ТАБЛ", "ТАБЛИЦА", "ТЕХ", "ТРЕБ", "ТРЕБОВАНИЯ", "ФОРМАТ", "КОПИРОВАЛ", "ИНВ", "ПОДЛ",
)
TITLE_STARTS = ("жгут", "кабель", "сборка", "шнур", "переходник", "блок", "панель", "адаптер")
TITLE_BANNED = (
    "лит.", "лист", "листов", "формат", "масса", "масштаб", "разраб.", "пров.", "т. контр.",
    "н. контр.", "утв.", "подп.", "дата", "копировал", "сборочный чертеж", "спецификация",
    "перечень элементов", "схема электрическая", "см.тт", "см. тт", "гост", "ту", "ост", "п.",
    "направление текста", "остальные", "герметиком", "анатерм", "унигерм", "loctite",
)
TITLE_TAIL_BANNED = ("гост", "ту", "ост", "п.")
MASS_BY_TABLE_MARKERS = ("см.табл", "см.тт", "смтт", "смтабл")
STATUS_REPLACE = ("зам", "замен", "заменен", "замена")
STATUS_NEW = ("нов", "новый")

# ---- fixed values: requirement topics, first matching marker wins --------------------------
REQUIREMENT_TOPICS = (
    ("неуказанные предельные отклонения размеров", "предельных отклонениях размеров"),
    ("экранирование цепей", "экранировании цепей"),
    ("бирки поз. 1, 2 установить", "размещении бирок"),
    ("установить в соответствии с ост 1 00031", "размещении бирок"),
    ("на расстоянии от 50 до 70 мм", "размещении бирок"),
    ("жгут обмотать тканью", "защитной намотке жгута и отводов Экран, GND"),
    ("защитную намотку", "защитной намотке жгута и отводов Экран, GND"),
    ("заделку выполнить на борту", "заделке на борту"),
    ("со стороны соединителя, заделываемого на борту",
     "размещении бирок со стороны соединителя, заделываемого на борту"),
    ("маркировку по пп. 7 - 9", "маркировке по пп. 7-9"),
    ("маркировку по пп. 7-9", "маркировке по пп. 7-9"),
    ("заделку проводов", "заделке проводов в соединители"),
    ("разделение электр", "разделении электрических цепей"),
    ("цепь 004", "выполнении цепи 004"),
    ("экраны проводов", "соединении экранов"),
    ("экранирование кабеля", "экранировании кабеля"),
    ("жгут по всей длине", "прокладке жгута в плетенках"),
    ("отводов экран", "заделке отводов Экран и GND"),
    ("провода со стороны отводов", "заделке отводов Экран и GND"),
    ("зазор между стволом", "компенсации зазора между стволом жгута и кожухом соединителей"),
    ("скручивать провода", "скрутке проводов"),
    ("маркировать каждый проводник", "маркировке проводников"),
    ("маркировать наименование", "маркировке наименования и обозначения жгута"),
    ("маркировать позиционное обозначение соединителей в соответствии с таблицей",
     "маркировке позиционного обозначения соединителей"),
    ("маркировать позиционное обозначение соединителя",
     "маркировке позиционного обозначения соединителей"),
    ("s, не сгибать", "маркировке позиционного обозначения соединителей"),
    ("маркировку по пп", "маркировке по пп."),
    ("бирки термоусадить", "размещении бирок"),
    ("резьбовые соединения", "контровке резьбовых соединений"),
    ("монтаж проводников выполнить кабелем", "замене сечения кабеля"),
    ("cat5e", "замене сечения кабеля"),
)
TOPIC_DEFAULT = "содержании пункта"
TOPIC_EMPTY = "требовании"
TOPIC_TEXT_STOPS = (" выполнить ", " установить ", " расстоянии от ", "поз. ", "гост ", "ост ")
TOPIC_BAD_STARTS = (
    "неуказанные ", "экранирование ", "бирки поз.", "маркировать ",
    "разделение электрических цепей выполнить", "жгут ",
)
TOPIC_BAD_PARTS = (
    " выполнить ", " установить в соответствии", " расстоянии от ", "ост 1 ", "гост ", "поз. ",
)
TOPIC_SUPPLIED_BAD_PARTS = (
    "...", "…", "заделку выполнить", "маркировать ", "бирки поз.", "установить в соответствии",
    "выполнить пле", "полный текст",
)
TOPIC_TOKEN_STOPS = (
    "изменение", "изменении", "пункт", "пункта", "требование", "требования", "данных",
    "значений", "значения", "выполнить", "согласно", "соответствии", "между", "после", "перед",
    "кроме", "путем", "поз", "гост", "ост",
)
TOPIC_ANCHORS = (
    "намот", "экранир", "компенсац", "зазор", "размещ", "бир", "маркиров", "скрутк", "скручив",
    "предельн", "отклонен",
)
TOPIC_ROOTS = (
    "провод", "кабел", "жгут", "скруч", "скручив", "проклад", "прокладыв", "маркиров", "соедин",
    "экран", "экранир", "задел", "обжим", "наконеч", "бир", "контров", "резьб", "компенсац",
    "зазор", "кожух", "ствол", "цеп",
)
VOWELS = "аеёиоуыэюя"

# ---- fixed values: encoding-repair hints ---------------------------------------------------
ENCODING_HINTS = (
    "формат", "зона", "поз", "обознач", "наимен", "кол", "примеч", "документац",
    "прочие изделия", "материал", "лит", "лист", "листов", "перв", "примен", "подп", "дата",
    "инв", "справ", "изм", "докум", "сборочный чертеж", "спецификация", "жгут", "кабель", "рспг",
)

# ---- fixed values: notice wording ----------------------------------------------------------
NOTES_HEADER = "Примечания:"
DEFAULT_JOURNAL = "Журнал № XX, запись № XX."
DEFAULT_NOTE = "Изменения требуют уточнения."
ACTION_REPLACE = "Заменить"

# ---- connection diagrams: fixed values -------------------------------------------------------
CONNECTOR_LETTERS = ("ХхРрТтСс", "XxPpTtSs")
CONNECTOR_NAME = r"^X[SPTK][0-9]+[A-Z0-9-]*$"
CONDUCTOR = r"(?iu)^(?:[0-9]{3}|б/н|-)$"
PIN = r"(?iu)^(?:[0-9]{1,2}|[A-ZА-ЯЁ])$"
LETTER_HEADER = r"(?iu)(?:^|[^A-Za-zА-Яа-яЁё0-9_])лит(?:$|[^A-Za-zА-Яа-яЁё0-9_])"
LETTER_LABEL = r"(?iu)(?:лит(?:ера)?|лит\.)\s*[:.]?\s*([A-ZА-Я]{1,3})(?:$|[^A-Za-zА-Яа-яЁё0-9_])"

# ---- what notes are checked for: fixed values ------------------------------------------------
GRAPHICS_WORDS = ("графика", "графику", "графики", "графикой", "графическое", "графические")
RAW_REQUIREMENT_MARKERS = (
    "заделку выполнить", "маркировку по пп.", "бирки термоусадить", "неуказанные предельные отклонения", "позиционные обозначения согласно",
    "заделку проводов в соединители", "приемку кабеля выполнять",
)
REQUIREMENT_NOTE_STARTS = (
    "изменены тт", "изменены технические требования", "- изменен пункт", "- введен пункт", "- аннулирован пункт", "изменен пункт", "введен пункт", "аннулирован пункт",
)
BAD_REQUIREMENT_FRAGMENTS = ("...", "…", " о неуказанные ", " об экранирование ", " о бирки ", " о маркировать ", " выполнить пле")

# ---- titles in a stamp: fixed values ---------------------------------------------------------
STAMP_SERVICE_WORDS = (
    "разраб", "пров", "н. контр", "т. контр", "утв", "лист", "листов", "масса", "масштаб", "лит", "формат", "подп", "дата", "изм", "инв", "зам", "перв",
    "справ", "копировал", "стадия", "докум", "см.", "см",
)
STAMP_MASS = r"(?iu)(?:масса|mass)\s*[:.]?\s*(\d+(?:[.,]\d+)?)"
STAMP_TAILS = (r"(?iu)(^|[^A-Za-zА-Яа-яЁё0-9_])(?:АО|ООО|ПАО|ЗАО)(?:$|[^A-Za-zА-Яа-яЁё0-9_]).*",
               r"(?iu)(^|[^A-Za-zА-Яа-яЁё0-9_])(?:Лист|Листов|Формат|См|Изм)(?:$|[^A-Za-zА-Яа-яЁё0-9_]).*")
