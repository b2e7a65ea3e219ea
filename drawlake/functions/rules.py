"""Ordered rule tables. A rule is (label, keywords): the first one of which a keyword occurs in the lower-cased text wins.

All word lists, codes and limits here are fixed values: results depend on them as they stand.
"""

from __future__ import annotations

Rules = tuple[tuple[str, tuple[str, ...]], ...]

PANEL = ("щит", "що", "щао", "цсао", "вру", "панель питания", "распределительное устройство")
PICTOGRAM = ("пиктограмма", "пэу")
INDICATOR = ("указатель", "mercury", "atom", "выход", "exit")
SOCKET = ("розетк",)
CABLE_OUTLET = ("кабельный вывод",)
SWITCH = ("выключатель", "пост управления", "коробк", "датчик", "блок аварийн")
TRAY = ("лоток", "лотка", "кабельный канал", "кабель-канал")
TRAY_ACCESSORY = (
    "соединительная пластина", "соединитель лотк", "угол горизонтальный", "угол плоский", "угол внутр", "угол внеш",
    "т-ответвитель", "консоль сварн", "консоль усилен", "подвес для лотк", "подвес потолочн",
    "стойка потолочного подвеса", "скоба для настенного крепления", "универсальная скоба", "усиленная скоба",
    "универсальный профиль", "прижим лестнич", "прижим лотк", "поворот 90 град", "планка шарнирного соединения",
    "кронштейн настенный соединительный лестничного",
)
MATERIAL = ("гофротруб", "стяжк", "металлоконструкц", "дюбель", "хомут", "крепеж", "кронштейн", "рамка", "гильза", "трубка термо", "термоусад", "пена", "пистолет для", "гильза закладн")
NON_EQUIPMENT = ("прокладка", "проводка", "кабельная трасса", "групповая сеть", "кабель ", "распаечная", "противопожарная", "подключение", "кабеленесущ", "точечное оборудование на плане", "кабельная конструкция")
CABLE_SPEC = ("ппгнг", "ввгнг", "вбшвнг", "кгнг", "апвпу", "пвпу", "кабель силовой", "0,66кв", "1кв", "пувв", "пвс", "пв1 ", "пв3 ", "шввп", "ппв ", "апв ")
CONDUIT = ("труба пвх", "гофр.", "с протяжкой", "держатель с защелкой")
GROUNDING = (
    "заземлен", "заземляющ", "уравнивания потенциалов", "стержень заземления", "контрольного соединения", "токоотвод",
    "проводник", "плоский проводник", "забивная головка", "соединитель диагональн", "соединитель плоского",
    "проводника к точке", "скоба на ленте", "шина уравнивания", "пугвнг", "провод пугв", "пруток-полоса",
    "антикоррозийная лента", "антикоррозионная лента", "спрей цинковый", "цинковый спрей", "свартон цинк",
    "коробка уравнивания", "точка заземления", "гидроизоляционн", "гидроизолирующ", "ма-943", "мз-910", "мш-926",
    "мш-830", "соединитель токоотвода с арматур", "держатель пластиковый", "держатель клик",
    "с бетоном для круглых проводников",
)
LIGHTNING = (
    "молниезащит", "молниеприемни", "проводник круглый", "мостовая опора", "держатель на кровлю",
    "лента монтажная на кровельный", "зажим крепежный", "держатель для круглых", "болтовой на водосточный",
    "универсальный для прутка", "мс-021", "мс-022", "мд-080", "ма-082", "мд-120", "мс-131", "компенсатор, алюминий",
    "мс-090", "обойма для круглого проводника на водосток",
)

#: Sections of the bill for a plan's equipment; anything else is a luminaire, unless it is marked as made up.
EQUIPMENT: Rules = (("skip", NON_EQUIPMENT), ("material", MATERIAL), ("panel", PANEL), ("pictogram", PICTOGRAM), ("indicator", INDICATOR), ("socket", SOCKET), ("cable_outlet", CABLE_OUTLET), ("switch", SWITCH))
#: Sections for the rows of a specification; anything else is material.
SPECIFICATION: Rules = (
    ("panel", PANEL), ("material", ("наклейк",)), ("pictogram", PICTOGRAM), ("indicator", INDICATOR), ("luminaire", ("светильник",)),
    ("socket", SOCKET), ("cable_outlet", CABLE_OUTLET), ("cable", CABLE_SPEC), ("pvc_conduit", CONDUIT), ("lightning", LIGHTNING),
    ("grounding", GROUNDING), ("switch", SWITCH), ("tray", TRAY), ("tray", TRAY_ACCESSORY),
)
#: Plan types by words of the file name.
PLAN: Rules = (
    ("розетки", ("розеточн",)), ("расположение", ("расположени", "расстановк")), ("привязка", ("привязк",)), ("освещение", ("освещени",)),
    ("кабеленесущие", ("кабеленесущ",)), ("схема", ("схем",)), ("общие", ("общие данные",)), ("опросные", ("опросн",)),
)
#: Works on earthing parts by words of their name, in order; anything else is mounted.
GROUNDING_WORKS: Rules = (
    ("Забивка", ("стержень заземления",)),
    ("Установка", ("наконечник", "соединитель", "забивная головка", "скоба", "шина уравнивания", "коробка уравнивания")),
    ("Прокладка", ("полоса", "проводник", "пруток")), ("Защита болтовых соединений системы заземления", ("антикоррози", "гидроизоля", "лента")),
    ("Окраска", ("спрей", "окраска", "свартон")), ("Монтаж", ("точка заземления",)), ("Установка", ("держатель",)), ("Прокладка", ("провод пугв", "пугвнг")),
)
#: Categories of legend entries; '' for others.
LEGEND: Rules = (
    ("эвакуационный", ("эвакуационный", "выход")), ("светильник", ("светильник", "светодиодный")), ("выключатель", ("выключатель",)),
    ("розетка", ("розетка",)), ("щит", ("щит",)), ("кабельная трасса", ("кабельная трасса",)), ("проводка", ("проводка",)),
)
#: Categories of the rows of a bill kept as text; Unknown for others.
TEXT_BILL: Rules = (
    ("Luminaire", ("светильник", "светодиодн", "led")), ("Panel", ("щит", "що", "щао")), ("Switch", ("выключатель",)), ("Socket", ("розетка",)), ("Cable", ("кабел", "провод")),
)
#: Classes of written bills, by patterns for lower-cased names; other for the rest.
BILL = (
    ("luminaire", "светильник"), ("socket", "розетк"), ("switch", "выключатель"), ("panel", "щит|щр|що|вру|щэ"), ("cable", "кабел|ввг|nym"), ("wire", "провод"),
    ("conduit", "трубы?|лот[оа]к|короб"), ("junction_box", "коробк|распред"), ("exit_sign", "указатель|exit|выход"), ("sensor", "датчик|извещатель"),
    ("circuit_breaker", "автомат|предохранитель|дифф"), ("grounding", "заземл"), ("work_item", "монтаж"),
)
#: How luminaires are mounted, by patterns in any case; stud for the rest.
MOUNTING = (
    ("wall", r"CD\s*LED|MARS\s+[0-9]|SAFARI\s+DL|SVT-ZKH|аварийн|emergency|CONVERSION\s+KIT"), ("anchor", r"INSEL\s+LB|INSEL\s+LED|LB/S\s+LED"), ("pendant", r"OWP\s+OPTIMA|подвесн"),
)
#: Words and parts of words of title blocks; notes that stray into descriptions, longer ones first; and the longest description.
TITLE_WORDS = ("Лист", "док.", "Подп.", "Дата", "Разраб.", "Пров.", "Н.контр.", "ГИП", "Изм.", "Стадия")
TITLE_PARTS = ("Формат", "ЛистДата", "Подп.", "N dok", "Kol.uch", "Izm.", "Нач.отд", "ГИП", "Разраб.", "Пров.", "Н.контр")
NOTES = ("Коробки распаячные установить", "Монтаж крайних на линии", "Монтаж крайних", "крайних на линии", "Расчет количества", "Для соединения", "установить на", "согласно проекту")
LONGEST_DESCRIPTION = 150
SUSPICIOUS = r"Лист(?![0-9A-Za-z_А-Яа-яЁё])|Подп\.|Дата(?![0-9A-Za-z_А-Яа-яЁё])|Разраб\.|Пров\.|Н\.контр|ГИП(?![0-9A-Za-z_А-Яа-яЁё])|Изм\.|Стадия(?![0-9A-Za-z_А-Яа-яЁё])|масштаб|формат"
#: Labels of known colours.
COLOURS = (
    ((0, 0, 0), "Чёрный / Рамка"), ((1, 0, 0), "Красный / Аварийное"), ((0, 0, 1), "Синий / Рабочее"), ((0, 1, 0), "Зелёный"), ((1, 1, 0), "Жёлтый"), ((1, 0, 1), "Пурпурный"), ((0, 1, 1), "Голубой"),
)
HEIGHTS = ((5.0, "до 5 метров"), (13.0, "от 5 до 13 метров"), (20.0, "от 13 до 20 метров"))
HIGHEST = "от 20 до 35 метров"
LUMINAIRE_PREFIXES = ("Светодиодный светильник ", "Светильник ", "Световые указатели ", "Световой указатель ")
NON_COUNTABLE_PREFIXES = ("Прокладка", "Проводка", "Кабельная трасса", "Групповая сеть", "Кабель ", "Распаечная", "Противопожарная кабельная", "Щит аварийного", "Щит рабочего")
UNITS = {
    "шт": "шт", "штук": "шт", "штука": "шт", "м": "м", "метр": "м", "метров": "м", "мп": "м.п.", "м п": "м.п.", "пм": "м.п.", "п.м": "м.п.",
    "м.п": "м.п.", "компл": "комп", "комплект": "комп", "комп": "комп", "м3": "м3", "куб": "м3", "каб": "каб.", "изм": "изм.",
}
#: Kilograms a metre by cores and section.
CABLE_WEIGHTS = {
    (2, 1.5): 0.10, (3, 1.5): 0.15, (4, 1.5): 0.18, (5, 1.5): 0.22, (2, 2.5): 0.14, (3, 2.5): 0.22, (4, 2.5): 0.27, (5, 2.5): 0.33,
    (3, 4.0): 0.31, (4, 4.0): 0.39, (5, 4.0): 0.47, (3, 6.0): 0.42, (4, 6.0): 0.54, (5, 6.0): 0.66, (3, 10.0): 0.65, (4, 10.0): 0.82,
    (5, 10.0): 0.95, (5, 16.0): 1.30, (4, 16.0): 1.10, (5, 25.0): 1.90, (4, 25.0): 1.55, (5, 35.0): 2.70, (4, 35.0): 2.15,
    (5, 50.0): 3.60, (4, 50.0): 2.90, (5, 70.0): 5.00, (4, 70.0): 4.00, (5, 95.0): 7.00, (4, 95.0): 5.50, (5, 120.0): 8.70,
    (4, 120.0): 7.00, (5, 150.0): 10.5, (4, 150.0): 8.50, (5, 185.0): 13.0, (4, 185.0): 10.5, (5, 240.0): 17.0, (4, 240.0): 13.5,
}
MASS_LIMITS = (1, 2, 3, 6, 9, 15, 20, 30)
SECTION_LIMITS = (6, 16, 35, 70, 120, 240)
CONDUIT_LIMITS = ((1.5, 16), (2.5, 20), (6.0, 25))
#: Brands as they stand on pages written backwards.
REVERSED_BRANDS = ("гнГПП", "гнвШБВ", "гнГВВ", "ГВВA")
#: What a symbol's label looks like, labels that are counted for themselves, and what no annotation begins with.
LABEL = r"^[0-9]{1,2}[А-Яа-яЁё]{0,3}$"
SPECIAL_LABELS = ("ВЫХОД",)
NO_ANNOTATION = ("На отм", "Щ", "ВРУ", "Гр.")
#: Lines of running text that hold numbers of grid axes or long numbers.
GRID_LINE, NUMBER_LINE = r"^[0-9]+(\s+[0-9]+){3,}$", r"^[0-9]{4,}(\s+[0-9]{4,})*$"
#: Texts of a legend that are neither symbols nor descriptions, and what blocks' names of axes and rooms hold.
LEGEND_SKIP = ("Условные обозначения", "Обозначение", "Наименование", "Примечание", "Обозначение на планах сети")
LEGEND_NOISE = r"^(?:Щ[А-ЯЁ]*[0-9].*Гр\.|ЩР[0-9]|РП[0-9]|На отм|[0-9]+[хx×][0-9])"
NO_BLOCK = "ось|сетки|помещен"
#: What tells suppliers, catalogue codes and models in the rows of a specification.
SUPPLIERS = ("systeme electric", "ostec", "ооо ", "оао ", "«dkc»", "световые технологии", "мгк ", "электрокабель")
CATALOGUE = r"^[A-Za-z0-9]{5,}[-]?[A-Za-z0-9]*$"
SERIES = ("LED", "OPL", "ECO", "ARCTIC", "SLICK", "MARS", "LUNA", "STAR", "INSEL", "NERO", "MERCURY")
NO_CATALOGUE = ("ВБШвнг", "ППГнг", "ВВГнг", "FRHF", "ПуГВнг", "ПуВВнг", "ПуВВ", "ПВС", "ПВ1", "ПВ3", "ШВВП", "ППВ", "АПВ")
MODELS = ("CONVERSION", "SIRAH", "ATLASDESIGN", "ETUDE")
WIRE_PREFIXES = ("ПуВВнг", "ПуВВ", "ПВС", "ПВ1", "ПВ3", "ШВВП", "ППВ", "АПВ")
#: Code pages that a garbled name was read in, and those it was written in.
CODE_PAGES = (("cp857", "cp866"), ("cp850", "cp866"), ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("latin-1", "cp866"), ("iso-8859-15", "cp1251"), ("cp437", "cp866"))

#: Work categories: (category, pattern, work template, unit) in order; patterns are for lower-cased names.
WORKS = (
    ("junction_box", r"коробк.*(?:распред|ответвит|соединит|установочн|монтажн)|коробк.*(?:ip|пластик)", "Монтаж коробки {}", "шт"),
    ("luminaire_emergency", r"(?:светильник|светил\.).*(?:аварийн|эвакуац|exit|выход|указат|пиктограмм)", "Монтаж светильника аварийного {}", "шт"),
    ("luminaire_exit", r"(?:указатель|табло).*(?:exit|выход|эвакуац|аварийн)", "Монтаж указателя аварийного освещения {}", "шт"),
    ("luminaire", r"светильник|светил\.", "Монтаж светильника {}", "шт"),
    ("frame", r"рамк[аи]", "Установка рамки {}", "шт"),
    ("socket", r"розетк", "Монтаж розетки {}", "шт"),
    ("circuit_breaker", r"^(?=.*(?:выключатель|выкл\.)).*(?:автомат\S*\s+выкл|дифф?\s*автомат)", "Монтаж автоматического выключателя {}", "шт"),
    ("switch", r"выключатель|выкл\.", "Монтаж выключателя {}", "шт"),
    ("panel", r"^(?:щр|що|щао|щвн|щв|щэ|вру|щу|грщ)(?:[-\s]\d|\d|$)|^щит\s|^пд\s|^ру\s|щит\s+(?:распределительн|осветительн|управлен|силов)", "Монтаж щита распределительного {}", "комп"),
    ("cable_entry", r"кабельн\S*\s+вывод", "Монтаж кабельного вывода", "шт"),
    ("cable", r"кабель|кабел[ья]|^ввг|^ппгнг|^nym|^кг\s|^кввг|^вбшв|^авбб?шв|^аввг|^пвс\s", "Прокладка кабеля {}", "м"),
    ("ground_rod", r"стержен.*заземлен|электрод.*заземлен|забивк.*заземл", "Забивка стержня заземления {}", "шт"),
    ("ground_strip", r"полос[аы]?\s*(?:стальн|оцинков|заземл|40)", "Прокладка заземлителя горизонтального {}", "м"),
    ("equipotential", r"уравнивани.*потенциал|потенциал.*уравнивани", "Прокладка проводника уравнивания потенциалов", "м"),
    ("grounding", r"проводник.*заземлен|заземлител.*горизонт", "Прокладка горизонтального заземлителя", "м"),
    ("grounding", r"заземл|зазем\.|заземлител", "Прокладка заземлителя", "м"),
    ("lightning", r"молниезащит|молниеприёмник|молниеприемник|токоотвод", "Монтаж молниезащиты", "м"),
    ("conductor", r"проводник", "Прокладка проводника", "м"),
    ("wire", r"провод(?:\s|$|[а-яё])|^пугв|^пув\s", "Прокладка провода {}", "м"),
    ("cable_tray", r"лот[оа]к|кабельрост", "Монтаж лотка кабельного {}", "м"),
    ("conduit_pipe", r"труба|гофр[аы]?(?:труб)?|^пнд\s|^пвд\s|кабель-?канал|^короб\s", "Монтаж трубы гофрированной {}", "м"),
    ("sensor", r"датчик|извещатель|детектор", "Монтаж датчика {}", "шт"),
    ("circuit_breaker", r"автомат\S*\s+выкл|автомат(?:\s|$)|предохранитель|узо(?:\s|$)|дифф?\s*автомат", "Монтаж автоматического выключателя {}", "шт"),
    ("contactor", r"контактор|пускатель|реле(?:\s|$)", "Монтаж контактора {}", "шт"),
    ("din_rail", r"дин.?рейк|din.?рейк", "Монтаж оборудования на DIN-рейку {}", "шт"),
    ("terminal", r"клемм|наконечник|гильз|соединител", "Подключение {}", "шт"),
)
_E = "[0-9a-zA-Z_а-яА-ЯёЁ]"
_NOUNS = (r"^(?:светильник|розетк[аи]|выключатель|коробк[аи]|датчик|извещатель|указатель|кабельн\S*\s+вывод|кабель|провод(?:ник)?|труб[аы]|лот[оа]к|щит|короб|автомат(?:ический)?\s*(?:выключатель)?|рамк[аи]|контактор|пускатель|реле|клеммник|полос[аы]|стержен[ьи]|электрод|молниезащит\S*|молниеприёмник|молниеприемник|токоотвод)\s*", "")
_SECTION = (rf"(?<!{_E})сечением?(?!{_E})\s*", "")
#: What a work's detail leaves out of the name, by category: (pattern in any case, what stands in its place) in order; the leading noun for the rest.
DETAILS = {
    "": (_NOUNS,),
    "luminaire": ((r"^светильн\S*\s*", ""),),
    "luminaire_emergency": ((r"^светильн\S*\s*", ""), (r"\s*(?:аварийн\S*|эвакуационн\S*)\s*", " ")),
    "cable": ((r"^кабель\s*", ""), _SECTION, (rf"(?<!{_E})сеч\.?\s*", ""), (r"\s*\(прокладка\)\s*", " "), (rf"\s*\([^)]*(?:Щ|Гр\.?)(?:{_E}|-)*\)\s*$", ""), (r"\s*\(\?-[^)]*\)\s*", "")),
    "wire": ((r"^провод\s*", ""), _SECTION),
    "conduit_pipe": ((r"^(?:труб[аы]|гофр[оа]?труб[аы]?|кабель-?канал|короб)\s*", ""),),
    "cable_tray": ((r"^лот[оа]к\s*", ""),),
    "ground_rod": (_NOUNS, (r"^заземлени\S*\s*", "")),
    "ground_strip": (_NOUNS, (r"^заземлени\S*\s*", "")),
}
#: How panels are named; the detail of their works where it occurs.
PANEL_NAME = rf"((?:ЩР|ЩО|ЩАО|ЩВН|ЩВ|ЩЭ|ВРУ|ПД|ЩУ|ГРЩ|РУ)[\s-]*[0-9]*(?:{_E}|-)*)"

_W = "[0-9a-zA-Z_а-яА-ЯёЁ]"
#: Rewrites that make names of generated and written bills comparable, in order; for lower-cased text.
KEY_REWRITES = (
    (r"^(монтаж|установка|прокладка|забивка|крепление|окраска|подключение)\s+", ""),
    (rf"светильник{_W}*", "светильник"), (rf"розетк{_W}*", "розетка"), (rf"выключател{_W}*", "выключатель"), (rf"коробк{_W}*", "коробка"),
    (rf"датчик{_W}*", "датчик"), (rf"лот[оа]к{_W}*", "лоток"), (rf"указател{_W}*", "указатель"), (rf"щит{_W}*", "щит"), (rf"труб{_W}*", "труба"),
    (rf"автомат{_W}*", "автомат"), (rf"кабел{_W}*", "кабель"), (rf"провод{_W}*(\s|$)", "провод$1"),
    (rf"светодиодн{_W}*\s+светильник", "светильник"), (rf"светильник\s+светодиодн{_W}*", "светильник"),
    (rf"\s+в\s+подвесн{_W}*\s+потолк{_W}*", ""),
    (rf"\s+(?:на\s+)?(?:высоте?\s+)?(?:до|от)\s+[0-9]+\s*(?:до\s+[0-9]+\s*)?(?:метр{_W}*|м)($|[^0-9a-zA-Z_а-яА-ЯёЁ])", "$1"),
    (rf"\s+настенн{_W}*", ""), (rf"\s+потолочн{_W}*", ""), (rf"\s+(?:подвесн{_W}*|анкерн{_W}*|на\s+шпильк{_W}*)", ""), (r"\s+в\s+сборе", ""),
    (rf"щит\s+(?:распределительн{_W}*|осветительн{_W}*|силов{_W}*)\s*", "щит "), (rf"лоток\s+кабельн{_W}*\s*", "лоток "), (rf"\s*аварийн{_W}*\s*", " "),
    (r",?\s*[0-9]{5,}[0-9\s,]*$", ""), (r",?\s*(?:dks|ostec|ekf|iek|abb|systeme\s+electric|сзим)($|[^0-9a-zA-Z_а-яА-ЯёЁ].*$)", ""),
    (r"(^|[^0-9a-zA-Z_а-яА-ЯёЁ])[a-z]{2,}[0-9][0-9a-zA-Z_а-яА-ЯёЁ-]{3,}", "$1"),
    (rf"\((?:до|от|суммарн|однополюс|двухполюс|масс{_W}*)[^)]*\)", ""), (r"\(прокладка\)", ""),
    (r",?\s*(?:цвет\s+[^\s]+|белый|серый|чёрный|черный)\s*,?", ""), (r"[0-9]{3,4}\s*[kк]\s*", ""), (rf"[0-9]+\s*[вw]t{_W}*", ""), (rf"[0-9]+\s*[лl]м{_W}*", ""),
    (r"сечением?(\s+|$)", ""), (r"\s+", " "),
)

#: Words below a header that tell a legend without lines from other text.
TABLE_WORDS = ("светильник", "розетка", "выключатель", "кабель", "щит", "провод", "лампа", "датчик", "извещатель", "оповещатель")
#: Fixed value: words that tell a frame without a header as a legend.
FRAME_WORDS = (*TABLE_WORDS, "трасса", "автомат", "узо", "дифавтомат")
#: What names of lit signs hold besides their model.
SIGN_NAME = rf"(?:светов{_E}*\s+указател{_E}*|указател{_E}*)"
SIGN_TEXT = r"[\s\"«»“”]*[\"«“]?выход[\"»”]?[\s\"«»“”]*"

#: Sections of a whole bill in order, with their headers; '' for rows under the header before.
BILL_SECTIONS = (
    ("panels", "Щитовое оборудование"), ("lights", "Монтаж светильников и ламп"), ("devices", "Монтаж электроустановочных изделий"), ("materials", "Монтажные изделия и материалы"),
    ("cables", "Кабель {}"), ("wires", "Провод"), ("spec_cables", "Кабельная продукция (дополнительно по спецификации)"), ("trays", "Монтаж кабельных лотков и соединительных деталей"),
    ("penetrations", ""), ("conduit", "Монтаж ПВХ изделий и труб"), ("grounding", "Монтаж системы заземления"), ("lightning", "Монтаж системы молниезащиты"), ("tests", "Пусконаладочные работы"),
)
#: The header of specified cables where none are drawn, and the sections that every bill has.
SPEC_CABLES_ONLY = "Кабельная продукция (по спецификации)"
ALWAYS = ("conduit", "grounding", "lightning", "tests")
#: Works of single items: (kind, section, place in it, work).
ITEM_WORKS = (
    ("spec_panel", "panels", 2, "Монтаж {}"), ("switch", "devices", 1, "Монтаж {}"), ("socket", "devices", 2, "Монтаж {}"), ("outlet", "devices", 3, "Монтаж {}"),
    ("material", "materials", 1, "{}"), ("spec_cable", "spec_cables", 1, "Кабель {}"), ("lightning", "lightning", 1, "{}"),
)
PANEL_WORK = "Монтаж щита распределительного {}"
#: Works of luminaires by how they are mounted, in order; of signs; and what luminaires are called below.
MOUNTING_WORKS = (
    ("stud", "Монтаж светильников на шпильках к перекрытию на высоте {}:"), ("wall", "Монтаж настенного светодиодного светильника на высоте {}:"),
    ("anchor", "Монтаж светильников анкерный на высоте {}:"), ("pendant", "Монтаж светильников подвесной на высоте {}:"),
)
SIGN_WORK, LUMINAIRE = "Монтаж настенного указателя светодиодного (с пиктограммой) {}:", "Светодиодный светильник {}"
#: Works and materials that follow from others: (what, section, place in it, line, name); line 0 is a work of its own.
DERIVED_ROWS = (
    ("connections", "panels", 3, 0, "Подключение жил кабелей до 10 мм2"), ("boxes_power", "devices", 4, 0, "Монтаж коробки соединительной с кабельными вводами 100x100x50 мм"),
    ("boxes_lighting", "devices", 5, 0, "Монтаж коробки распределительной 85x85x40 мм"), ("sleeves", "devices", 6, 1, "Луженая гильза ГМЛ"), ("shrink", "devices", 6, 2, "Термоусадочная трубка ТТК (4:1)"),
    ("foam", "penetrations", 1, 1, "Двухкомпонентная огнестойкая пена, DN1201"), ("gun", "penetrations", 1, 2, "Пистолет для двухкомпонентной пены, DN1202"),
    ("steel_sleeves", "penetrations", 1, 3, "Гильза закладная труба сталь ВГП Ду 20 (Дн 26,8x2,5) ГОСТ 3262-75"),
)
#: Works without a quantity over derived materials: (what must be there, section, place in it, name).
DERIVED_HEADS = (("sleeves", "devices", 6, "Соединение жил кабелей методом опрессовки"), ("steel_sleeves", "penetrations", 1, "Выполнение проходки кабеля через стены"))
#: Names of a bill's own items that stand for derived boxes and sleeves.
OWN_BOXES, OWN_SLEEVES = r"коробк", r"гмл|^(?!.*закладн).*гильза"
#: How cables are laid, by patterns in small letters, and their works.
UNDERGROUND, IN_TRAY, IN_CONDUIT, USUAL_LAYING = r"в трубе|в земле|в траншее", r"лотке|лотк", r"гофре|кабель-канал", "в лотке"
LIGHT_CABLE = "массой до 1 кг"
UNDERGROUND_WORK, WIRE_WORK = "Прокладка кабеля в земле", "Прокладка провода с медной многопроволочной жилой, допускающего частые изгибы. Размотка провода с барабана"
TRAY_WORK = "Лоток металлический штампованный по установленным конструкциям, ширина лотка: до 200 мм, высота {}:"
METRES = ("м", "м.", "м.п.", "м. п.")
#: Tray accessories: (name, metres of tray to one, how many at least); bolts go with plates and turns twice, with supports once.
TRAY_PARTS = (("Соединительная пластина для лотка", 3.0, 1), ("Угол горизонтальный 90 гр.", 15.0, 1), ("Т-ответвитель", 25.0, 1), ("Консоль / подвес для лотка", 1.5, 2), ("Анкерный болт с гайкой", 1.5, 2))
TRAY_BOLTS = "Болт, гайка, шайба (комплект крепежа)"
CONDUIT_WORK, CONDUIT_PIPE = "Монтаж гофрированной трубы ПВХ гибкой гофр. с креплением клипсами каждые 0,8 метра на высоте {}:", "Труба ПВХ гибкая гофр. д.{}мм, лёгкой с протяжкой"
CONDUIT_HOLDER, PULLING_WORK, PULLING_LINES = "Держатель оцинкованный двусторонний, д.{}мм, с крепежными отверстиями 6,5 х 5 мм", "Затяжка кабеля в гофрированные трубы", "~{} линий (уточнить по планам)"
#: Rows for the hand to fill in where nothing is known.
BLANK = {"pulling": "[Гофротруба ПВХ -- марка и количество по кабеленесущим планам]", "conduit": "[Заполнить вручную]", "grounding": "[Заполнить вручную из проекта заземления]", "lightning": "[Заполнить вручную из проекта молниезащиты]"}
ELECTRODES, EQUALISATION, EQUALISATION_WORK = r"стержень заземления|электрод", r"уравнивания потенциалов|коробка уравнивания|шина уравнивания", "Монтаж системы уравнивания потенциалов"
EARTHWORKS = ("Разработка грунта для прокладки горизонтального заземлителя.", "Засыпка траншеи (под горизонтальное заземление).")
#: Tests: (quantity, work, unit) in order; of each panel; of the lighting network.
TESTS = (
    ("lines", "Измерение сопротивления изоляции", "каб."), ("lines", "Определение целостности жил кабеля и фазировка кабельной линии", "каб."),
    ("measurements", "Проверка наличия цепи между заземлителями и заземленными элементами", "изм."), ("phase_checks", "Лаборатория передвижная монтажно-измерительная", "маш/час"),
)
PANEL_TEST, LIGHTING_TEST = "Проверка срабатывания автоматических выключателей в щите {} (однополюсных/трехполюсных)", "Проверка осветительной сети на правильность зажигания групп внутреннего освещения"
