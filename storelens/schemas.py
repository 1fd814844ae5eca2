"""Shapes of the report document and of the record table.

Fixed values: field names and nesting of a stored report, so that stored reports stay readable.
"""

PRODUCT_FIELDS = {
    "id": "bigint",
    "title": "string",
    "handle": "string",
    "description": "string",
    "vendor": "string",
    "product_type": "string",
    "tags": "array<string>",
    "price": "string",
    "compare_at_price": "string",
    "available": "boolean",
    "images": "array<string>",
    "variants": "array<string>",
    "created_at": "timestamp",
    "updated_at": "timestamp",
}
PRODUCT = "struct<" + ",".join(f"{k}:{v}" for k, v in PRODUCT_FIELDS.items()) + ">"
CATALOG = f"struct<total_products:bigint,products:array<{PRODUCT}>,has_more:boolean,next_page_url:string>"
HERO = (
    "struct<title:string,description:string,image_url:string,product_url:string,price:string,"
    "featured_section:string>"
)
POLICY = "struct<title:string,content:string,url:string,last_updated:timestamp,type:string>"
FAQ = "struct<question:string,answer:string,category:string,order:int>"
CONTACT = (
    "struct<emails:array<string>,phone_numbers:array<string>,addresses:array<string>,"
    "contact_form_url:string,support_url:string>"
)
SOCIAL = "map<string,array<string>>"
BRAND = (
    "struct<name:string,description:string,mission:string,story:string,values:array<string>,"
    "founded:string,location:string>"
)
LINK = "struct<title:string,url:string,description:string,category:string>"
COMPETITOR = (
    "struct<name:string,website_url:string,description:string,estimated_products:bigint,price_range:string,"
    f"social_presence:{SOCIAL}>"
)

# Order of the fields is the order of the document.
REPORT_FIELDS = {
    "store_url": "string",
    "store_name": "string",
    "is_shopify_store": "boolean",
    "product_catalog": CATALOG,
    "hero_products": f"array<{HERO}>",
    "privacy_policy": POLICY,
    "return_refund_policy": POLICY,
    "terms_of_service": POLICY,
    "shipping_policy": POLICY,
    "other_policies": f"array<{POLICY}>",
    "faqs": f"array<{FAQ}>",
    "contact_info": CONTACT,
    "social_handles": SOCIAL,
    "brand_context": BRAND,
    "important_links": f"array<{LINK}>",
    "competitors": f"array<{COMPETITOR}>",
    "scraped_at": "double",
    "processing_time": "double",
    "success": "boolean",
    "errors": "array<string>",
    "warnings": "array<string>",
}
REPORT = "struct<" + ",".join(f"{k}:{v}" for k, v in REPORT_FIELDS.items()) + ">"

RECORD = (
    "id string, store_url string, store_name string, insights_data string, scraped_at timestamp, "
    "processing_time double, success boolean, error_message string, scraped_date date"
)
