"""Small checked-in name lists: first names to detect, pools to invent from."""

# First names known to the person detector (pass a gazetteer table for more).
FIRST_NAMES = (
    "James Robert John Michael David William Richard Joseph Thomas Charles Christopher Daniel "
    "Matthew Anthony Mark Donald Steven Paul Andrew Joshua Kenneth Kevin Brian George Timothy "
    "Ronald Edward Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin "
    "Scott Brandon Benjamin Samuel Gregory Frank Alexander Raymond Patrick Jack Dennis Jerry "
    "Tyler Aaron Jose Adam Nathan Henry Peter Mary Patricia Jennifer Linda Elizabeth Barbara "
    "Susan Jessica Sarah Karen Lisa Nancy Betty Margaret Sandra Ashley Kimberly Emily Donna "
    "Michelle Carol Amanda Dorothy Melissa Deborah Stephanie Rebecca Sharon Laura Cynthia "
    "Kathleen Amy Angela Shirley Anna Brenda Pamela Emma Nicole Helen Samantha Katherine "
    "Christine Rachel Carolyn Janet Catherine Maria Heather Diane Ruth Julie Olivia Joyce "
    "Virginia Alice Bob Tom Jane Carlos Luis Ahmed Fatima Priya Hans Pierre Sofia"
).split()

# Surnames that may also begin a sentence as a common word, without an article.
COMMON_WORDS = (
    "white black brown green gray grey young long short little best good rich strong wise early english small sharp "
    "west north summer winter spring snow day love may mark will grant chase cross fall fish hunt march park price rice "
    "power pace light gold stone wood banks waters"
).split()

# Company names known without a legal suffix.
COMPANIES = (
    "Google,Microsoft,Amazon,Apple,Facebook,Netflix,Intel,Oracle,Siemens,Samsung,Toyota,Volkswagen,"
    "Walmart,Starbucks,Goldman Sachs,Morgan Stanley,Deutsche Bank,Coca-Cola"
).split(",")

# Pools for invented values.
INVENTED_FIRST = (
    "Alex Elena Nina Clara Irene Marta Lucia Petra Vera Ines Anton Felix Hugo Oscar Leon Milo "
    "Bruno Viktor Emil Ivo"
).split()
INVENTED_LAST = (
    "Chen Garcia Novak Lindqvist Okafor Tanaka Moreau Rossi Haddad Kowalski Silva Petrov "
    "Larsen Mbeki Duarte Farkas Ivanov Keller Nakamura Osei"
).split()
INVENTED_COMPANY_HEAD = (
    "Techflow Datasphere Northwind Brightline Clearwater Summit Redwood Bluepeak Ironbridge "
    "Silverleaf Oakstone Starfield Greenway Lakeshore Highmark Fairview"
).split()
INVENTED_COMPANY_TAIL = "Industries Inc Systems Partners Group Labs Holdings Solutions".split()
INVENTED_STREETS = "Oak Maple Cedar Elm Walnut Birch Chestnut Willow Juniper Laurel".split()
# (city, state)
INVENTED_CITIES = [
    ("Chicago", "IL"),
    ("Denver", "CO"),
    ("Portland", "OR"),
    ("Austin", "TX"),
    ("Madison", "WI"),
    ("Atlanta", "GA"),
    ("Phoenix", "AZ"),
    ("Columbus", "OH"),
]
