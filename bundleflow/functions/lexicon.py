"""Word lists, patterns and thresholds that decide results.

Everything in this module is data.  The values are fixed: changing one changes
which names match, which tags are set or which mailbox a document goes to.
"""

# --- fixed values: thresholds and limits ----------------------------------
SUPPLIER_THRESHOLD = 85
SENSITIVE_THRESHOLD = 90
ENTITY_THRESHOLD = 80
VN_THRESHOLD = 80
MIN_LEN_FOR_PARTIAL = 6
MIN_LEN_FOR_SUPPLIER_PARTIAL = 4
MIN_STEM_FOR_PREFIX = 4
MAX_ZIP_DEPTH = 3
NAME_LIMIT = 60
CONFIG_CODE = "G"
VN_ENTITY = "LE763"

# --- fixed values: sentinels and junk -------------------------------------
NULL_SENTINELS = ["none", "null", "n/a", "na", "nil", ""]
EMPTY_NAMES = ["", "nan", "none"]
JUNK_ALT_NAMES = [".", "-", "", "nan", "none", "n/a"]
JUNK_ENTITY_MARKS = ["do not scan", "send it to", "@"]
SKIP_ATTACHMENTS = ["image001.png", "image002.png", "image003.png", "oledata.mso", "winmail.dat"]

# --- fixed values: file types ---------------------------------------------
PDF_TYPES = [".pdf"]
EXCEL_TYPES = [".xlsx", ".xlsm", ".xls"]
XML_TYPES = [".xml"]
ZIP_TYPES = [".zip"]
MAIL_TYPES = [".msg", ".eml"]

# --- fixed values: patterns -----------------------------------------------
PO_PATTERN = r"\b(350\d{7}|300\d{7}|5906\d{6}|4506\d{6}|4501\d{6}|4502\d{6}|700\d{7})\b"
ARTIFACT_PATTERN = r"\+[A-Z]\d+"
CJK_CLASS = (
    r"[\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff\u3000-\u303f"
    r"\u3040-\u309f\u30a0-\u30ff\uac00-\ud7af]"
)
DAY_LETTERS = ["M", "T", "W", "H", "F", "S", "U"]  # Monday first

# Dotted legal forms, applied in this order to lower-cased text.
DOTTED_FORMS = [
    (r"\bk\.?\s*k\.?\b", "kabushiki kaisha"),
    (r"\bz\.?\s*o\.?\s*o\.?\b", "spzoo"),
    (r"\bd\.?\s*o\.?\s*o\.?\b", "doo"),
    (r"\br\s*&\s*d\b", "research and development"),
    (r"\bs\.\s*p\.\s*a\.?\b", "spa"),
    (r"\bs\.\s*a\.\s*s\.?\b", "sas"),
    (r"\bs\.\s*a\.?\b", "sa"),
    (r"\bs\.\s*l\.?\b", "sl"),
    (r"\bb\.\s*v\.?\b", "bv"),
    (r"\bn\.\s*v\.?\b", "nv"),
]

# --- fixed values: abbreviations expanded in names -------------------------
ABBREVIATIONS = {
    "svcs": "services", "svc": "services", "serv": "services",
    "corp": "corporation", "corpn": "corporation",
    "intl": "international", "intnl": "international", "internatl": "international",
    "natl": "national",
    "tech": "technology", "techs": "technologies", "technol": "technology",
    "sys": "systems", "syst": "systems",
    "comm": "communications", "comms": "communications", "commun": "communications",
    "elec": "electronics", "elect": "electronics", "electr": "electronics",
    "mfg": "manufacturing", "mfrs": "manufacturers", "mfr": "manufacturer",
    "div": "division", "divn": "division",
    "prod": "products", "prods": "products", "prd": "products",
    "sol": "solutions", "soln": "solutions", "solns": "solutions",
    "engg": "engineering", "engr": "engineering", "eng": "engineering",
    "ind": "industries", "inds": "industries", "indl": "industrial",
    "assoc": "associates", "assocs": "associates", "assn": "association",
    "grp": "group",
    "dist": "distribution", "distrib": "distribution",
    "mkt": "marketing", "mktg": "marketing", "mark": "marketing",
    "consult": "consulting", "cons": "consulting",
    "mgmt": "management", "mgt": "management",
    "sci": "scientific", "lab": "laboratories", "labs": "laboratories",
    "pharma": "pharmaceuticals", "pharm": "pharmaceuticals",
    "ctr": "center",
    "rnd": "research and development",
    "&": "and",
}

# --- fixed values: legal suffixes dropped for sensitive matching -----------
LEGAL_SUFFIXES = [
    "inc", "incorporated", "llc", "ltd", "limited", "co", "company",
    "gmbh", "ag", "sa", "sas", "sl", "srl", "spa", "bv", "nv", "plc",
    "pte", "pvt", "pty", "kg", "ab", "oy", "as", "aps", "sdn", "bhd",
    "lp", "llp", "sau", "sac", "sarl", "kk", "kabushiki", "ltda", "ooo",
    "sia", "oyj", "kft", "doo", "gk", "ug", "sro", "spzoo", "aktiebolag",
    "aktiengesellschaft", "sociedad", "anonima", "societe", "anonyme",
]

# --- fixed values: legal forms expanded for legal-entity matching ----------
ENTITY_EXPANSIONS = {
    "ltd": "limited", "ab": "aktiebolag", "pvt": "private",
    "ste": "societe", "hiz": "hizmetleri", "sti": "sirketi",
}

# --- fixed values: legal forms expanded for Vietnamese suppliers -----------
VN_EXPANSIONS = {
    "ltd": "limited", "co": "company", "corp": "corporation",
    "corpn": "corporation", "inc": "incorporated", "pte": "private",
    "pvt": "private", "sdn": "sendirian", "bhd": "berhad",
}

# --- fixed values: tag terms ------------------------------------------------
TELECOM_TERMS = [
    "telecom", "telecoms", "telecommunication", "telecommunications",
    "telco", "mobile", "wireless", "broadband", "cellular",
]

DIRECT_DEBIT_TERMS = ["direct debit", "DD"]  # "DD" cannot occur in lower-cased text

UTILITY_TERMS = {
    "base": [
        "utility", "water", "electricity", "power", "internet",
        "broadband", "broad band", "telecom", "telco", "gas",
    ],
    "korean": [
        "PBX를 포함한 통신 장비 유지관리", "통신", "임대", "부동산 서비스",
        "부동산 또는 건물 임대", "상하수도 서비스", "천연가스 공급", "전기 서비스",
        "전화 서비스", "무선 음성 또는 데이터 서비스 또는 휴대폰", "청구 서비스",
        "국민소득세", "소득세 이외의 세금, 재산세", "부가가치세", "관세",
        "공구 및 일반 기계 또는 장비 임대 또는 리스", "사무 장비 및 소모품 임대 또는 리스",
        "점심 식사 쿠폰, 교통비 등 직원 복리후생", "고객 할인", "원천징수세",
        "차량 리스 혜택",
    ],
    "japanese": [
        "PBXを含む通信機器の保守", "通信", "リース", "不動産サービス",
        "不動産または建物のリースおよびレンタル", "水道・下水道事業", "天然ガス供給",
        "電気事業", "電話サービス", "無線音声・データサービスまたは携帯電話",
        "課金サービス", "国民所得税", "所得税以外の税金、固定資産税",
        "付加価値税（VAT）", "関税違反", "工具および一般機械・設備のレンタルまたはリース",
        "事務機器および備品のレンタルまたはリース", "昼食券、交通費などの従業員福利厚生",
        "顧客割引", "源泉徴収税", "福利厚生車両リース",
    ],
    "twi": [
        "Maintenance Telecom Mfiri a PBX ka ho", "Telecom so nkitahodi", "Wɔagye atom",
        "Adan ne afie ho adwumayɛ", "Lease & rental of Agyapadeɛ anaa ɔdan",
        "Nsu ne nsu a ɛkɔ nsu mu a wɔde fa nsu mu", "Abɔde mu mframa a wɔde ma",
        "Nneɛma a wɔde anyinam ahoɔden di dwuma ", "telefon so dwumadi",
        "Wireless nne anaa data dwumadie anaa Mobile phone", "Nnwuma a wɔde tua ho ka",
        "Ɔman Sika a Wonya Tow", "Tow a ɛnyɛ sika a wonya fi mu tow. Agyapade Ho Towtua",
        "Tow a Wɔde Ka Ho VAT", "Amanneɛbɔ ho mfomso ahorow.",
        "Nnwinnade ne mfiri anaa nnwinnade a wɔde di dwuma nyinaa a wɔbɛtɔ anaa wɔagye",
        "Office nnwinnade ne nneɛma a wɔde tua ho ka anaasɛ wɔde ma afoforo",
        "Adwumayɛfoɔ mfasoɔ te sɛ awia aduane nkrataa, akwantuo",
        "Adetɔfo Sika a Wɔbɛsan Atua", "Tow a Wɔde Sie",
        "Mfaso a Ɛwɔ Kar a Wɔde Ma Wɔn Ho",
    ],
    "german": [
        "Wartung von Telekommunikationsgeräten einschließlich Nebenstellenanlagen",
        "Telekommunikation", "Leasing", "Immobiliendienstleistungen",
        "Leasing und Vermietung von Immobilien oder Gebäuden",
        "Wasser- und Abwasserversorgung", "Erdgasversorgung", "Stromversorgung",
        "Telefondienste", "Drahtlose Sprach- oder Datendienste oder Mobiltelefonie",
        "Abrechnungsdienste", "Einkommensteuer",
        "Steuern außer der Einkommensteuer. Grundsteuer", "Mehrwertsteuer",
        "Zolldelikte", "Miete oder Leasing von Werkzeugen und allgemeinen Maschinen oder Geräten",
        "Miete oder Leasing von Büroausstattung und -bedarf",
        "Mitarbeiterleistungen wie Essensgutscheine, Transport", "Kundenrabatte",
        "Quellensteuer", "Vergünstigungen Fahrzeugleasing",
    ],
    "czech": [
        "Údržba telekomunikačních zařízení včetně ústředen", "Telekomunikace",
        "Pronájem", "Realitní služby", "Pronájem nemovitostí nebo budov",
        "Vodovody a kanalizace", "Dodávky zemního plynu", "Elektřina",
        "Telefonní služby", "Bezdrátové hlasové nebo datové služby nebo mobilní telefon",
        "Fakturační služby", "Daň z příjmu",
        "Daně jiné než daň z příjmu. Daň z nemovitosti", "Daň z přidané hodnoty DPH",
        "Celní přestupky.", "Pronájem nebo leasing nástrojů a běžných strojů nebo zařízení",
        "Pronájem nebo leasing kancelářského vybavení a potřeb",
        "Zaměstnanecké výhody, jako jsou obědové poukázky, doprava", "Slevy pro zákazníky",
        "Srážková daň", "Výhody Leasing vozidel",
    ],
    "romani": [
        "Telekomunikaciaqo arakhipnasqo arakhipnasqo aparaturǎ inkluziv PBX", "Telekom",
        "Lesed", "Servisura pe imobilie", "Leasing & renting of Proprietat or building",
        "Pani thaj kanalizaciake utilitetura", "O furniziripe e naturalno gazosko",
        "Elektrikane utilitètură ", "telefonosko serviso",
        "Bi-telara glasoske vaj datake servisura vaj mobilno telefono",
        "Servisura vaś fakturacia", "Nacionalno taksa pe pokinipe",
        "Takse aver katar o takse pe inkomesti. Taksa pe Barvalipe",
        "O TVA vaś o thodino valuto", "Doganesqe ćhinadimata.",
        "Renta vaj lease e Alavengo thaj e generalno mašinengo vaj e aparaturengo",
        "Ofisoske aparatura thaj materialura te kines vaj te les",
        "Beneficije e butjarnenge sar kuponura vash habe, transporto",
        "Rebatură le kliènturenqe", "O ćhinavipen e takseqo",
        "Le laćhipenata vaś o ćhivipen e maśinenqo",
    ],
    "spanish": [
        "Mantenimiento de equipos de telecomunicaciones, incluyendo centralitas telefónicas (PBX)",
        "Telecomunicaciones", "Arrendamiento", "Servicios inmobiliarios",
        "Arrendamiento y alquiler de inmuebles", "Servicios de agua y alcantarillado",
        "Suministro de gas natural", "Servicios de electricidad", "Servicio telefónico",
        "Servicios de voz o datos inalámbricos o telefonía móvil", "Servicios de facturación",
        "Impuesto Nacional sobre la Renta",
        "Impuestos distintos del impuesto sobre la renta. Impuesto sobre Bienes Inmuebles",
        "Impuesto al Valor Agregado (IVA)", "Infracciones aduaneras",
        "Arrendamiento o alquiler de herramientas y maquinaria o equipo en general",
        "Arrendamiento o alquiler de equipos y suministros de oficina",
        "Beneficios para empleados como vales de almuerzo y transporte",
        "Descuentos para clientes", "Retención de impuestos",
        "Beneficios de arrendamiento de vehículos",
    ],
    "chinese_tw": [
        "包含專用交換機（PBX）的電信設備維護", "電信", "租賃", "不動產服務",
        "不動產或建築物的租賃", "自來水及污水服務", "天然氣供應", "電力服務",
        "電話服務", "無線語音或數據服務或行動電話", "帳單服務", "國民所得稅",
        "所得稅以外之稅捐，財產稅", "加值稅（營業稅）", "海關違規",
        "工具及一般機械或設備租賃", "辦公設備及用品租賃", "員工福利，如午餐券、交通補助",
        "客戶折扣", "扣繳稅款", "車輛租賃福利",
    ],
    "romanian": [
        "Întreținerea echipamentelor de telecomunicații, inclusiv centrale telefonice (PBX)",
        "Telecomunicații", "Leasing", "Servicii imobiliare",
        "Leasing și închiriere de proprietăți sau clădiri", "Servicii de apă și canalizare",
        "Furnizare de gaze naturale", "Servicii de electricitate", "Servicii telefonice",
        "Servicii de voce sau date wireless sau telefonie mobilă", "Servicii de facturare",
        "Impozitul național pe venit",
        "Impozite altele decât impozitul pe venit. Impozitul pe proprietate",
        "Taxa pe valoarea adăugată (TVA)", "Infracțiuni vamale",
        "Închirierea sau leasingul uneltelor și utilajelor sau echipamentelor generale",
        "Închirierea sau leasingul echipamentelor și consumabilelor de birou",
        "Beneficii pentru angajați, cum ar fi tichete de masă, transport",
        "Reduceri pentru clienți", "Impozitul reținut la sursă", "Beneficii de leasing auto",
    ],
}

# Zone names of mail dates (RFC 2822) and their offsets.
MAIL_ZONES = {
    "UT": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "Z": "+00:00",
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00",
    "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
}
