"""Values that are fixed by the data model: codes, labels, lists and prices."""

# Status codes and their display labels.
SOURCE_STATUS = {
    "cr": "Создан",
    "ready": "Готов",
    "de": "Удален",
    "ex": "Исключен из базы знаний",
    "er": "Ошибка",
    "wait": "ожидает решения задачи",
    "active": "используется в базе знаний",
}
CONTENT_STATUS = {
    "ready": "Готов к работе",
    "error": "Ошибка",
    "canceled": "Отменен",
    "active": "Активен",
}
CHUNK_STATUS = CONTENT_STATUS
TASK_STATUS = {
    "created": "ожидает",
    "solved": "решена",
    "rejected": "отклонена",
}

# Why a change task is opened, by the status of the source.
CHANGE_REASON = {
    "ready": "Обновился исходный контент для АКТИВНОГО источника...",
    "de": "Обновился исходный контент для УДАЛЕННОГО источника...",
    "ex": "Обновился исходный контент для ИСКЛЮЧЕННОГО источника...",
    "er": "Обновился исходный контент для источника в статусе ОШИБКА...",
    "wait": "Обновился исходный контент для источника в статусе ОБРАБОТКА...",
}

# USD per million tokens as (input, cached input, output); None = not offered.
TOKEN_PRICES = {
    "gpt-5": (1.25, 0.125, 10.0),
    "gpt-5-mini": (0.25, 0.025, 2.0),
    "gpt-5-nano": (0.05, 0.005, 0.4),
    "gpt-4.1": (2.0, 0.5, 8.0),
    "gpt-4.1-mini": (0.4, 0.1, 1.6),
    "gpt-4.1-nano": (0.1, 0.025, 0.4),
    "gpt-4o": (2.5, 1.25, 10.0),
    "gpt-4o-audio-preview": (2.5, None, 10.0),
    "gpt-4o-realtime-preview": (5.0, 2.5, 20.0),
    "gpt-4o-mini": (0.15, 0.075, 0.6),
    "gpt-4o-mini-audio-preview": (0.15, None, 0.6),
    "gpt-4o-mini-realtime-preview": (0.6, 0.3, 2.4),
    "o1": (15.0, 7.5, 60.0),
    "o1-pro": (150.0, None, 600.0),
    "o3-pro": (20.0, None, 80.0),
    "o3": (2.0, 0.5, 8.0),
    "o3-deep-research": (10.0, 2.5, 40.0),
    "o4-mini": (1.1, 0.275, 4.4),
    "o4-mini-deep-research": (2.0, 0.5, 8.0),
    "o3-mini": (1.1, 0.55, 4.4),
    "o1-mini": (1.1, 0.55, 4.4),
    "codex-mini-latest": (1.5, 0.375, 6.0),
    "gpt-4o-mini-search-preview": (0.15, None, 0.6),
    "gpt-4o-search-preview": (2.5, None, 10.0),
    "computer-use-preview": (3.0, None, 12.0),
    "gpt-image-1": (5.0, 1.25, None),
}
UNKNOWN_MODEL_PRICE = 1_000_000.0

# File name endings.
DOCUMENT_EXTENSIONS = ["pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "rtf"]
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "bmp", "webp", "svg"]
PICTURE_LINK_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "bmp"]
NON_PAGE_EXTENSIONS = [
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "zip", "rar", "7z", "tar", "gz", "mp4", "mp3", "exe",
    "jpg", "jpeg", "png", "gif", "svg", "webp", "ico",
    "csv", "json", "xml",
]

# Default page clean-up lists.
EXCLUDED_TAGS = [
    "footer", "header", "nav", "menu", "sidebar", "popup", "modal", "banner", "ad",
    "subscribe", "widget", "cookie", "social", "share", "logo", "script", "style", "form",
    "input", "iframe", "svg", "noscript", "button", "select", "option", "canvas", "link",
    "meta", "jdiv",
]
EXCLUDED_IDS = ["preload"]
EXCLUDED_CLASSES = [
    "header__top", "coast_block", "express_test_marquiz", "order_tel", "cf7_form", "sw-app",
    "modal", "calc", "category__info-sale", "breadcrumbs", "my_yandex_centered_text",
    "calc-block", "form-wrapper",
]
STYLE_TAGS = ["strong", "b", "i", "em", "u", "span"]
USEFUL_IMAGE_CLASSES = ["attachment-full", "size-full"]
BREADCRUMB_SELECTOR = ".breadcrumbs a"

# Texts shown to the user.
NO_RESULT_TEXT = "Пожалуйста, задайте вопрос иначе или уточните его."
NOT_FOUND_TEXT = "не обнаружено"
TITLE_PREFIX = "Заголовок: "
TAGS_PREFIX = "Категории: "
LINKS_HEADING = "Полезные материалы:"
SOURCE_LINE = "\n Сcылка на источник документа: "
EXCERPT_HEADING = "Документ "
NO_TAG_DATA = "(недостаточно данных)"
TAGS_IMPOSSIBLE = "(не удалось выделить теги)"

# Code point ranges removed as emoji, as (first, last).
EMOJI_RANGES = [
    (0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F700, 0x1F77F),
    (0x1F780, 0x1F7FF), (0x1F800, 0x1F8FF), (0x1F900, 0x1F9FF), (0x1FA00, 0x1FA6F),
    (0x1FA70, 0x1FAFF), (0x2700, 0x27BF), (0x2600, 0x26FF),
]
# Emoji outside those blocks: signs, arrows, clocks, squares, flags, enclosed letters, selectors.
MORE_EMOJI_RANGES = [
    (0x00A9, 0x00A9), (0x00AE, 0x00AE), (0x203C, 0x203C), (0x2049, 0x2049), (0x20E3, 0x20E3),
    (0x2122, 0x2122), (0x2139, 0x2139), (0x2194, 0x2199), (0x21A9, 0x21AA), (0x231A, 0x231B),
    (0x2328, 0x2328), (0x23CF, 0x23CF), (0x23E9, 0x23F3), (0x23F8, 0x23FA), (0x24C2, 0x24C2),
    (0x25AA, 0x25AB), (0x25B6, 0x25B6), (0x25C0, 0x25C0), (0x25FB, 0x25FE), (0x2934, 0x2935),
    (0x2B05, 0x2B07), (0x2B1B, 0x2B1C), (0x2B50, 0x2B50), (0x2B55, 0x2B55), (0x3030, 0x3030),
    (0x303D, 0x303D), (0x3297, 0x3297), (0x3299, 0x3299), (0x1F004, 0x1F004),
    (0x1F0CF, 0x1F0CF), (0x1F170, 0x1F171), (0x1F17E, 0x1F17F), (0x1F18E, 0x1F18E),
    (0x1F191, 0x1F19A), (0x1F1E6, 0x1F1FF), (0x1F201, 0x1F202), (0x1F21A, 0x1F21A),
    (0x1F22F, 0x1F22F), (0x1F232, 0x1F23A), (0x1F250, 0x1F251), (0xFE0F, 0xFE0F),
]
