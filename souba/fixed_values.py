"""Fixed values.

Word lists, lookup tables, text patterns and constants whose exact content
decides results. They are data, not logic, and are kept together here in their
natural order so that they can be checked and extended in one place.
"""

from __future__ import annotations

# --- fixed values: brands and model families -------------------------------
BRANDS = [
    "Lenovo", "Dell", "HP", "Hewlett-Packard", "ASUS", "Acer",
    "Toshiba", "Fujitsu", "Panasonic", "NEC", "Sony", "Microsoft",
    "Apple", "MSI", "Samsung", "Dynabook", "Sharp",
]
MODEL_FAMILIES = [
    "ThinkPad", "IdeaPad", "Latitude", "Inspiron", "XPS", "Optiplex",
    "EliteBook", "ProBook", "ZBook", "Spectre", "Envy", "Pavilion",
    "VivoBook", "ZenBook", "TravelMate", "Aspire", "Swift", "Spin",
    "FMV", "LIFEBOOK", "VersaPro", "Let's Note",
]
BRAND_FUZZY_CUTOFF = 70
MEMORY_SIZES_GB = [2, 4, 6, 8, 12, 16, 24, 32, 48, 64]
DISPLAY_RANGE_INCH = (10.0, 20.0)
WEIGHT_RANGE_KG = (0.5, 5.0)
CPU_GENERATION_RANGE = (1, 14)
PRESENT = "搭載"

# --- fixed values: text patterns (searched case-insensitively) --------------
BRAND_FIELD = r"メーカー[名]?\s*[：:]\s*([\w\s]+?)(?:\n|　|,|型番)"
MODEL_FIELD = r"型番\s*[：:]\s*([\w\s\-]+?)(?:\n|　|CPU|メモリ|OS)"
OS_NAME = r"(Windows\s*1[01]\s*(?:Pro|Home|Professional)?\s*(?:64bit|32bit)?)"
CPU_JAPANESE = (
    r"インテル[®™]*\s+Core[™®]*\s+[i][3579]"
    r"(?:[-\s]\d{4,5}[A-Z]*(?:\s*プロセッサー?)?"
    r"|\s+プロセッサー?\s+\d{4,5}[A-Z]*)"
    r"(?:\s*[\(（]\s*[^\)）\n]{0,50}[\)）])?"
)
CPU_LATIN = (
    r"(?:intel\s+)?Core[™®]*\s+[i][3579][-\s]\d{4,5}[A-Z]*"
    r"(?:\s*\d+\.\d+\s*(?:GHz|MHz))?(?:\s*[\(（][^\)）\n]{0,30}[\)）])?"
)
GENERATION_ENGLISH = r"(\d+)(?:st|nd|rd|th)\s*[Gg]en"
GENERATION_FROM_CPU = r"Core[™®]*\s+[i][3579][-\s](\d)\d{3}[A-Z]"
MEMORY = [
    r"(?:メモリ[容量]?\s*[：:（(]?\s*|RAM\s*[：:\s]+|MEM\s*[：:\s]+)(\d+)\s*GB",
    r"(\d+)GB\s*\(スロット",
    r"DDR[3-5](?:L|LP)?\s+(\d+)\s*GB",
    r"/(\d+)GB(?:\s+DDR[3-5](?:L|LP)?)?/",
]
SSD = [
    r"(?:新品\s*)?(?:NVMe[式]?\s*)?(?:M\.2\s*)?SSD\s*[：:\s]*(\d+)\s*(GB|TB)",
    r"容量[（(]SSD[）)]\s*[：:]\s*(\d+)\s*(GB|TB)",
    r"(\d+)\s*(GB|TB)\s*(?:新品\s*)?(?:NVMe[式]?\s*)?(?:M\.2\s*)?SSD",
]
HDD = [
    r"HDD\s*[：:\s]*(\d+)\s*(GB|TB)",
    r"(\d+)\s*(TB)\s*HDD",
]
DISPLAY = [
    r"(?:ディスプレイ|液晶|画面)[^0-9]*(\d+(?:\.\d+)?)\s*(?:型|インチ|inch)",
    r"(\d+(?:\.\d+)?)\s*(?:型|インチ|inch)\s*(?:ワイド|液晶|IPS|TN)",
    r"(\d+(?:\.\d+)?)-inch",
]
WEIGHT = [
    r"重[さ量][：:\s]*(\d+(?:\.\d+)?)\s*kg",
    r"重さ[：:\s]?(\d+(?:\.\d+)?)\s*kg",
]
BLUETOOTH_VERSION = r"Bluetooth\s+(\d+\.\d+)"
BLUETOOTH = r"Bluetooth"
WEBCAM = [
    r"(?:Web)?[Cc]amera\s*[：:]\s*([\w\s]+p)",
    r"Webカメラ\s*[：:]\s*([\w\s]+)",
    r"HD\s*720p|1080p",
]
WEBCAM_PRESENT = r"Webカメラ|webcam|カメラ搭載"
USB_30 = r"USB\s*3\.0\s*[×x×]\s*(\d+)"
USB_31C = r"USB\s*3\.1\s*Type[-\s]?C\s*[×x×]?\s*(\d+)"
USB_C = r"USB\s*(?:Type[-\s]?C|3\.1\s*Type[-\s]?C)"

# --- fixed values: text patterns (case matters) -----------------------------
GENERATION_JAPANESE = r"第\s*(\d+)\s*世代"
GENERATION_FROM_NUMBER = r"\b(\d{1,2})(\d{3})[UYHQGP]\b"

# --- fixed values: patterns of the optional fields --------------------------
RESOLUTION = r"(\d{3,4})[×xｘ×](\d{3,4})"
RESOLUTION_FULL_HD = r"フルHD|Full\s*HD|FHD"
RESOLUTION_HD = r"\bHD\b"
PANEL_IPS = r"\bIPS\b"
PANEL_TN = r"\bTN\b"
WIRELESS = [
    r"(802\.11\s*[a-z/]{2,8})",
    r"(Wireless[-\s]AC\s*\d+)",
    r"\b(ac/a/b/g/n)\b",
]
WIRELESS_PRESENT = r"WiFi|Wi-Fi|無線LAN"
OPTICAL_NONE = r"光学[ドド]ライブ[：:\s]*(?:な[しい]|非搭載|無し|なし)"
OPTICAL_KIND = r"光学[ドド]ライブ[：:\s]*(DVD|CD|Blu[-\s]?ray)"
OPTICAL_DVD_NONE = r"DVD.*?(?:非搭載|なし|無し)"
WARRANTY = [
    r"保証期間[：:\s]*(\d+年間?|\d+ヶ?月間?)",
    r"(\d+年間?)(?:の)?(?:動作)?保証",
    r"保証[：:\s]*(\d+日間)",
]
OFFICE_NONE = r"オフィスソフト[：:\s]*な[しい]|Officeなし|Office\s*非搭載"
OFFICE = [
    r"Microsoft\s*Office\s*\d{4}|MS\s*Office\s*\d{4}|Office\s*\d{4}",
    r"WPS\s*Office\s*\d+|WPS\s*Office",
]
TENKEY = r"テンキー|10キー|numpad"
NONE_WORD = "なし"

# --- fixed values: accessory filter -----------------------------------------
COMPUTER_GENRES = ["100040", "100026"]
NOISE_GENRES = ["552420"]
API_COMPUTER_GENRE = "100040"
# Plain "バッテリー" is not in the list on purpose: used-PC titles praise their battery.
NOISE_KEYWORDS = [
    "バッテリーパック", "バッテリー交換", "純正バッテリー", "交換用バッテリー", "互換バッテリー",
    "アダプター", "アダプタ", "充電器", "ACアダプター", "ACアダプタ",
    "電源アダプター", "電源アダプタ", "電源ケーブル",
    "ケーブル",
    "バッグ", "ケース",
    "マウス", "キーボード", "イヤホン", "ヘッドホン", "ヘッドフォン",
    "冷却", "クーラー", "スタンド",
    "ドッキング",
]
COMPUTER_KEYWORDS = [
    "ThinkPad", "レッツノート", "Let's note", "VAIO", "LIFEBOOK", "dynabook",
    "EliteBook", "ProBook", "Latitude", "Inspiron", "XPS", "Surface", "MacBook",
    "VivoBook", "ZenBook", "IdeaPad", "Pavilion", "MateBook",
    "Windows", "macOS", "Linux",
    "Core i", "Ryzen", "Celeron", "Pentium", "Xeon",
    "ノートパソコン", "ノートPC", "デスクトップ", "ラップトップ",
    "laptop", "notebook", "desktop",
]

# --- fixed values: shop vocabulary ------------------------------------------
BRAND_LABELS = {
    "Lenovo": "Lenovo",
    "レノボジャパン": "Lenovo",
    "FUJITSU": "Fujitsu",
    "富士通": "Fujitsu",
    "DELL": "Dell",
    "デル": "Dell",
    "hp": "HP",
    "エイチピー": "HP",
    "Panasonic": "Panasonic",
    "パナソニック": "Panasonic",
    "dynabook": "dynabook",
    "ダイナブック": "dynabook",
    "VAIO": "VAIO",
    "バイオ": "VAIO",
    "NEC": "NEC",
    "Apple": "Apple",
    "ASUS": "ASUS",
    "Microsoft": "Microsoft",
}
OTHER_BRAND = "その他"
CONDITION_GRADES = {
    "新品または未開封品": "S",
    "新品同様・展示使用のみ": "A",
    "使用感少なくきれいな状態": "A",
    "使用感あるが良い状態": "B",
    "やや汚れ・劣化あり": "C",
    "汚れ・劣化あり": "D",
    "一部機能に問題あり": "Junk",
}
BRACKET_CPU_WORDS = ["Core", "Ryzen", "Celeron", "AMD", "Pentium", "Atom", "Xeon"]
BRACKET_OS_WORDS = ["Windows", "Linux", "macOS", "Chrome"]
SPAN_OS_WORDS = ["Windows", "Linux", "Chrome OS", "macOS"]
SPAN_CPU_WORDS = ["Core", "Ryzen", "Celeron", "Pentium", "Atom", "Xeon"]
LINE_OS_WORDS = ["Windows", "macOS", "Chrome OS", "Linux"]
SLASH_CPU_WORDS = ["Core", "Ryzen", "Celeron"]
BLOCK_OS = r"OS\s*(Windows\S*\s*\S*|macOS\S*)"
BLOCK_CPU = r"CPU\s*(Core\s+i\d[^\n]+|Ryzen[^\n]+|Celeron[^\n]+|Pentium[^\n]+)"
BLOCK_STORAGE = r"ストレージ\s*(\d+)\s*(?:GB|TB)\s*(SSD|HDD|NVMe|M\.2|PCIe)?"
SOLD_OUT = "完売しました"

# --- fixed values: defaults and constants of the market queries --------------
DEFAULT_SOURCE = "rakuten"
UNKNOWN = "Unknown"
CHANGE_WINDOW_DAYS = 7
FLAT_CHANGE_PCT = 0.5
TOP_MODELS = 5
MIN_PRICES_FOR_HISTOGRAM = 5
CURVE_POINTS = 300
CURVE_SIGMAS = 3.5
SPEC_COLUMNS = ["memory", "cpu_gen", "ssd"]
DEFAULT_SPEC_PATTERNS = {"model": r"L390", "cpu": r"i5.?8\d{3}", "memory": r"8\s*GB", "ssd": r"256\s*GB"}
TRAIN_RATIO = 0.8
RANDOM_SEED = 42
MODEL_VERSION = "1.0.0"
