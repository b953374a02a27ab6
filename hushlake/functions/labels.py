"""Entity types: the built-in list and the localised labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.functions.text import js_trim

# Entity types every policy has a switch for, in display order.
BUILT_IN_TYPES = [
    "ACCOUNT_NUMBER",
    "ADDRESS",
    "PRIVATE_DATE",
    "EMAIL_ADDRESS",
    "PERSON",
    "PHONE_NUMBER",
    "URL",
    "SECRET",
]

# Display labels. Column order: type, zh, en, ja, de.
LOCALES = ["zh", "en", "ja", "de"]
LABELS = [
    ("PERSON", "姓名", "Person name", "個人名", "Personenname"),
    ("PHONE_NUMBER", "电话号码", "Phone number", "電話番号", "Telefonnummer"),
    ("EMAIL_ADDRESS", "电子邮箱", "Email address", "電子メール アドレス", "E-Mail-Adresse"),
    ("ADDRESS", "地址", "Address", "アドレス", "Adresse"),
    ("PRIVATE_DATE", "私密日期", "Private date", "プライベート日付", "Privates Datum"),
    ("ACCOUNT_NUMBER", "账户号码", "Account number", "口座番号", "Kontonummer"),
    ("IP_ADDRESS", "IP 地址", "IP address", "IP アドレス", "IP-Adresse"),
    ("SECRET", "密钥与凭证", "Secrets & credentials", "秘密と認証情報", "Geheimnisse und Anmeldeinformationen"),
    ("URL", "网址", "Web address", "Web アドレス", "Webadresse"),
    ("LOCATION", "位置", "Location", "位置", "Ort"),
    ("ORGANIZATION", "组织机构", "Organization", "組織", "Organisation"),
    ("BANK_ACCOUNT", "银行账户", "Bank account", "銀行口座", "Bankkonto"),
    ("BANK_CARD", "银行卡号", "Bank card number", "カード番号", "Kartennummer"),
    ("BANK_CARD_SECURITY_CODE", "银行卡安全码", "Bank card security code", "カード暗証コード", "Kartensicherheitscode"),
    ("BANK_CARD_EXPIRY", "银行卡有效期", "Bank card expiry", "カード有効期限", "Kartenablaufdatum"),
    ("NATIONAL_ID", "身份证件", "National ID", "個人番号", "Personalausweis"),
    ("GOVERNMENT_ID", "政府证件", "Government ID", "公的身分証", "Behördlicher Ausweis"),
    ("TAX_ID", "税号", "Tax ID", "納税者番号", "Steuer-ID"),
    ("PASSPORT", "护照", "Passport", "パスポート", "Reisepass"),
    ("PASSPORT_NUMBER", "护照", "Passport", "パスポート番号", "Reisepassnummer"),
    ("DRIVER_LICENSE", "驾驶证", "Driver's license", "運転免許証", "Führerschein"),
    ("DRIVERS_LICENSE", "驾驶证", "Driver's license", "運転免許証", "Führerschein"),
    ("VEHICLE_ID", "车辆标识", "Vehicle identifier", "車両識別子", "Fahrzeugkennung"),
    ("DEVICE_ID", "设备标识", "Device identifier", "デバイス ID", "Gerätekennung"),
    ("USERNAME", "用户名", "Username", "ユーザー名", "Benutzername"),
    ("PASSWORD", "密码", "Password", "パスワード", "Passwort"),
    ("PIN", "PIN 码", "PIN", "PIN", "PIN"),
    ("MAC_ADDRESS", "MAC 地址", "MAC address", "MAC アドレス", "MAC-Adresse"),
    ("USER_AGENT", "用户代理", "User agent", "ユーザーエージェント", "User-Agent"),
    ("CRYPTO_ADDRESS", "加密货币地址", "Cryptocurrency address", "暗号資産アドレス", "Krypto-Adresse"),
    ("DATE_OF_BIRTH", "出生日期", "Date of birth", "生年月日", "Geburtsdatum"),
]
CUSTOM_LABEL = ("自定义实体", "Custom entity", "カスタム エンティティ", "Benutzerdefinierte Entität")


def label_table(spark: SparkSession) -> DataFrame:
    """One row for each (locale, type) with its label."""
    rows = [(locale, row[0], row[i + 1]) for row in LABELS for i, locale in enumerate(LOCALES)]
    return spark.createDataFrame(rows, "locale string, type string, label string")


def label_types(df: DataFrame, type_col: str = "type", locale_col: str = "locale") -> DataFrame:
    """Add ``label``: the localised name, else the type itself, else "custom entity".

    The label table has a fixed size, so it is broadcast.
    """
    custom = F.create_map(*[F.lit(x) for pair in zip(LOCALES, CUSTOM_LABEL) for x in pair])
    raw = js_trim(F.col(type_col))
    labels = label_table(df.sparkSession).select(
        F.col("locale").alias("__locale"), F.col("type").alias("__type"), F.col("label").alias("__label")
    )
    joined = df.join(
        F.broadcast(labels),
        (F.col(locale_col) == F.col("__locale")) & (F.upper(raw) == F.col("__type")),
        "left",
    )
    label = F.coalesce(F.col("__label"), F.nullif(raw, F.lit("")), custom[F.col(locale_col)])
    return joined.withColumn("label", label).drop("__locale", "__type", "__label")
