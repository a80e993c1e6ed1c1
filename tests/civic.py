"""Tiny civic tables holding the edge cases, as CSV text."""

from pathlib import Path

TABLES = {
    "properties": """OBJECTID,STATE,ADDRESS,YEARBUILT,LAT,LON
1,SD,1 Main St,1990,43.5,-96.7
2,SD,1 MAIN ST,1950,43.6,-96.8
3,SD,2 Oak Ave,n/a,43.7,-96.9
4,SD,3 Elm,2015,,
5,SD,,1980,1.0,1.0
6,SD,4 Pine,2000,43.9,-97.1
""",
    "code_cases": """Address,Year,Code Case Type
1 main st,2010,Zoning
1 main st,2011,Zoning
1mainst,2019,Snow
1 main st,2018,Unlisted kind
1 main st,2018,
2 oak ave,2020,Zoning
4 pine,2016,Right of Way 
,2015,Zoning
0,2015,Zoning
""",
    "offenses": """Parcel_Address,Offense,Date
1 main st,Theft,2018-05-01
1 main st,Theft,2018-05-01
1 main st,Arson,2018-05-01
1 main st,Theft,2020-01-01
2 oak ave,Theft,2019-12-31 23:59:59
""",
    "utility_disconnects": """Address,Year
1 main st,2011
1 main st,2015
2 oak ave,2010
3 elm,2019
""",
    "rentals": """Address,Permit Issue Date
1 main st,1/2/2013
1 main st,2016-03-01
2 oak ave,someday
3 elm,2020-01-01
4 pine,6/30/2014 10:15
""",
    "incidents": """Location,Time,Code,Category,Type
1 main st,2020-05-01 10:00:00,111,f,t
1 main st,2021-05-01 10:00:00,111,f,t
2 oak ave,2020-05-01 10:00:00,321,f,t
3 elm,2022-01-01 00:00:00,111,f,t
4 pine,2015-07-01 00:00:00,111,f,t
""",
    "inspections": """Address,Scheduled Start Date,Status Name
1 main st,2015-01-01,Ready Anytime
1 main st,2016-01-01,Not Yet
1 main st,2017-01-01,
2 oak ave,2015-01-01,Ready Anytime
2 oak ave,2016-01-01,Ready Anytime
3 elm,2021-01-01,Ready Anytime
""",
    "parcels": """ADDRESS,ACTIVITY,SQFT,ACREAGE,FRONTFOOT,Shape_Length,Shape_Area,BuildVal,LandVal
1 main st,11,1,1,1,1,1,1,1
1 Main St,62,100.5,2,3,4,5,6,7
2 oak ave,39,1,,1,1,1,1,1
0,11,9,9,9,9,9,9,9
,11,8,8,8,8,8,8,8
""",
    "foreclosures": """ADDRESS,YEAR,NAME,AUCTIONDATE,ASSESSEDVALUE
1 main st,2012,x,y,1
1 main st,2018,x,y,1
2 oak ave,2015,x,y,1
4 pine,2014,x,y,1
3 elm,2020,x,y,1
""",
}


def write(folder: Path) -> str:
    for name, text in TABLES.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)
