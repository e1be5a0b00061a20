"""The series that the sources know by name: category, display name, and the symbols to try in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names and public symbols, one series a line.
SERIES = """
indices | S&P 500 | ^GSPC
indices | Dow Jones Industrial Average | ^DJI
indices | NASDAQ Composite | ^IXIC
indices | NASDAQ-100 | ^NDX
indices | Russell 2000 | ^RUT
indices | Russell 1000 | ^RUI
indices | Russell 3000 | ^RUA
indices | Wilshire 5000 | ^W5000, ^FTW5000, VTI
indices | NYSE Composite | ^NYA
indices | S&P MidCap 400 | ^MID
indices | S&P SmallCap 600 | ^SML, ^SP600, IJR
indices | S&P 100 | ^OEX
sectors | Technology | XLK
sectors | Financials | XLF
sectors | Healthcare | XLV
sectors | Energy | XLE
sectors | Utilities | XLU
sectors | Industrials | XLI
sectors | Consumer Discretionary | XLY
sectors | Consumer Staples | XLP
sectors | Materials | XLB
sectors | Real Estate | XLRE
sectors | Communication Services | XLC
sectors | Semiconductors | SMH
sectors | Biotechnology | IBB
sectors | Transportation | IYT
sectors | Software | IGV
sectors | Banks | KBE
sectors | Insurance | KIE
sectors | Homebuilders | XHB
sectors | Retail | XRT
sectors | Cloud Computing | SKYY
sectors | Cybersecurity | HACK
sectors | Clean Energy | ICLN
volatility | CBOE VIX | ^VIX
volatility | VXN (Nasdaq Volatility) | ^VXN
volatility | VVIX (VIX of VIX) | ^VVIX
volatility | MOVE Index (Bond Volatility) | ^MOVE, ^MOVE.X
volatility | Short-Term VIX (VIX9D) | ^VIX9D
volatility | 3-Month VIX (VIX3M) | ^VIX3M
volatility | RVX (Russell 2000 Volatility) | ^RVX
forex | US Dollar Index (DXY) | DX-Y.NYB, DX=F
forex | EUR/USD | EURUSD=X
forex | GBP/USD | GBPUSD=X
forex | USD/JPY | USDJPY=X
forex | USD/CHF | USDCHF=X
forex | USD/CAD | USDCAD=X
forex | AUD/USD | AUDUSD=X
forex | NZD/USD | NZDUSD=X
commodities | Gold Futures | GC=F
commodities | Silver Futures | SI=F
commodities | Copper Futures | HG=F
commodities | Platinum Futures | PL=F
commodities | Palladium Futures | PA=F
commodities | WTI Crude Oil | CL=F
commodities | Brent Crude Oil | BZ=F
commodities | Natural Gas | NG=F
commodities | Corn Futures | ZC=F
commodities | Wheat Futures | ZW=F
commodities | Soybean Futures | ZS=F
commodities | Coffee Futures | KC=F
commodities | Sugar Futures | SB=F
commodities | Cotton Futures | CT=F
commodities | Lumber Futures | LBS=F, LBR=F
yields | 1 Month Treasury Yield | DGS1MO
yields | 3 Month Treasury Yield | DGS3MO
yields | 6 Month Treasury Yield | DGS6MO
yields | 1 Year Treasury Yield | DGS1
yields | 2 Year Treasury Yield | DGS2
yields | 3 Year Treasury Yield | DGS3
yields | 5 Year Treasury Yield | DGS5
yields | 7 Year Treasury Yield | DGS7
yields | 10 Year Treasury Yield | DGS10
yields | 20 Year Treasury Yield | DGS20
yields | 30 Year Treasury Yield | DGS30
macro | CPI (All Urban Consumers) | CPIAUCSL
macro | Core CPI (ex Food & Energy) | CPILFESL
macro | PPI (All Commodities) | PPIACO
macro | Core PPI | PPIFES
macro | PCE Price Index | PCEPI
macro | Core PCE Price Index | PCEPILFE
macro | Unemployment Rate | UNRATE
macro | Initial Jobless Claims | ICSA
macro | Continuing Claims | CCSA
macro | Nonfarm Payrolls | PAYEMS
macro | Labor Force Participation Rate | CIVPART
macro | GDP (Nominal) | GDP
macro | Real GDP | GDPC1
macro | Industrial Production Index | INDPRO
macro | Capacity Utilization | TCU
macro | Retail Sales | RSAFS
macro | Housing Starts | HOUST
macro | Building Permits | PERMIT
macro | Existing Home Sales | EXHOSLUSM495S
macro | New Home Sales | HSN1F
macro | Fed Total Assets (Balance Sheet) | WALCL
macro | M2 Money Supply | M2SL
macro | Reverse Repo (RRP) | RRPONTSYD
macro | SOFR | SOFR
macro | Effective Fed Funds Rate | DFF
macro | Moody's AAA Corporate Spread | AAA10Y
macro | Moody's BAA Corporate Spread | BAA10Y
macro | High Yield Spread (ICE BofA) | BAMLH0A0HYM2
macro | Corporate Bond Spread (ICE BofA IG) | BAMLC0A0CM
macro | 10Y-2Y Treasury Spread | T10Y2Y
macro | 10Y-3M Treasury Spread | T10Y3M
macro | NBER Recession Indicator (USREC) | USREC
macro | Trade Weighted Broad Dollar Index | DTWEXBGS
macro | ISM Manufacturing PMI (proxy: New Orders) | AMTMNO
world | FTSE 100 (UK) | ^FTSE
world | DAX (Germany) | ^GDAXI
world | CAC 40 (France) | ^FCHI
world | Euro Stoxx 50 | ^STOXX50E
world | Nikkei 225 (Japan) | ^N225
world | TOPIX (Japan) | ^TPX, 1306.T
world | Hang Seng (Hong Kong) | ^HSI
world | Shanghai Composite (China) | 000001.SS
world | Shenzhen Component (China) | 399001.SZ
world | CSI 300 (China) | 000300.SS
world | KOSPI (South Korea) | ^KS11
world | ASX 200 (Australia) | ^AXJO
world | TSX Composite (Canada) | ^GSPTSE
world | Bovespa (Brazil) | ^BVSP
world | IPC Mexico | ^MXX
world | MSCI Emerging Markets (ETF proxy: EEM) | EEM
"""


def series() -> list[tuple[str, str, list[str]]]:
    parts = [[x.strip() for x in line.split(" | ")] for line in SERIES.strip().split("\n")]
    return [(category, name, [s.strip() for s in symbols.split(",")]) for category, name, symbols in parts]


def registry(spark: SparkSession) -> DataFrame:
    """(category, name, place, symbol): one row for each symbol, place 0 is tried first."""
    rows = [(category, name, k, symbol) for category, name, symbols in series() for k, symbol in enumerate(symbols)]
    return spark.createDataFrame(rows, "category string, name string, place int, symbol string")
